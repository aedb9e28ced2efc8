"""Schemas of the tables that readers produce and operators expect."""

from __future__ import annotations

FILES = (
    "id string, name string, mime_type string, size bigint, modified_time timestamp, created_time timestamp, "
    "parents array<string>, md5 string, width int, height int, web_view_link string, thumbnail_link string"
)
FOLDERS = "id string, parent_id string, name string"
CHANGES = "seq bigint, file_id string, removed boolean, trashed boolean, size bigint, modified_time timestamp"
REJECTIONS = "lo bigint, hi bigint, seq bigint"
ACTIONS = "seq bigint, id string, name string, action string, status int, ts timestamp"
FINGERPRINTS = (
    "id string, d8 bigint, d12 struct<w0:bigint,w1:bigint,w2:int>, "
    "variants array<struct<d8:bigint,d12:struct<w0:bigint,w1:bigint,w2:int>>>, "
    "crops array<struct<name:string,d12:struct<w0:bigint,w1:bigint,w2:int>>>, "
    "color_hist array<int>, edge_hist array<int>, phash bigint, error string"
)
