"""Plan helpers: shared-folder materialisation and the scan pipeline."""
