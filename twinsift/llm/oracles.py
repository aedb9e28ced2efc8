"""DuckDB SQL of the corpus queries that SQL can express.

The others need functions that DuckDB lacks (CRC-32, XXH64) or iterate; the
tests hold those against brute-force versions.
"""

from __future__ import annotations

from twinsift.llm.quality import MAX_REPEAT, MIN_GROUP, MIN_WORDS, SPREAD, SYMBOLS

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
TEST_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP3 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {TEST_WORDS} AS w FROM documents),
  i AS MATERIALIZED (SELECT item_id, {TEST_WORDS} AS w FROM benchmark),
  g AS MATERIALIZED (SELECT item_id, list_slice(w, p, least(p + 9, len(w))) AS ws FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
  q AS MATERIALIZED (SELECT DISTINCT ws, array_to_string(ws, ' ') AS phrase FROM g),
  t AS MATERIALIZED (SELECT doc_id, p, w[p] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
  lens AS (SELECT DISTINCT len(ws) AS n FROM q),
  m AS MATERIALIZED (SELECT x.doc_id, x.p, x.n, q.phrase FROM (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens)) x JOIN q ON x.phrase = q.phrase),
  hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM m) GROUP BY 1),
  found AS (SELECT DISTINCT m.doc_id, g.item_id FROM m JOIN g ON m.phrase = array_to_string(g.ws, ' ')),
  items AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS ids FROM found GROUP BY 1),
  df AS MATERIALIZED (SELECT term, count(*) AS n FROM t GROUP BY 1),
  lead AS MATERIALIZED (SELECT phrase, ws, arg_min(term, {{n: n, place: place, term: term}}) AS term FROM (SELECT phrase, ws, place, ws[place] AS term, coalesce(df.n, 0) AS n
    FROM (SELECT phrase, ws, unnest(range(1, len(ws) + 1)) AS place FROM q) a LEFT JOIN df ON a.ws[place] = df.term) GROUP BY 1, 2),
  close AS (SELECT DISTINCT t.doc_id, lead.phrase FROM t JOIN lead ON t.term = lead.term JOIN d ON d.doc_id = t.doc_id
    WHERE len(list_intersect(list_distinct(lead.ws), list_slice(d.w, greatest(t.p - 9, 1), t.p + 9))) >= 0.8 * len(list_distinct(lead.ws))),
  near AS (SELECT doc_id, count(DISTINCT coalesce(item_id, -1)) AS n_near FROM close JOIN g ON close.phrase = array_to_string(g.ws, ' ') GROUP BY 1)
  SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_near, 0)::bigint AS n_near, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""

_SAID = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPE = lambda x: f"replace(replace({x}, '%', '%25'), '<|', '%3C|')"

OP4 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
    (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}))
  SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || replace({_ESCAPE('role')}, chr(10), '%0A') || chr(10) || {_ESCAPE('text')} || '<|im_end|>' || chr(10)))::bigint AS formatted_chars FROM c GROUP BY conv_id"""

_RATE = lambda c: f"CASE WHEN n_words > 0 THEN {c} * 1000 // n_words ELSE 0 END"
_RATES = {"mean_chars": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words"}


def _quantiles(by: str) -> str:
    keys = f"{by}, signal" if by else "signal"
    return f"""(SELECT {keys}, max(total) AS total, min(top) FILTER (upto * 100 >= total * 50) AS q50, min(top) FILTER (upto * 100 >= total * 75) AS q75, min(top) FILTER (upto * 100 >= total * 90) AS q90,
      coalesce(min(top) FILTER (bin > 0 AND (upto - zero) * 100 >= (total - zero) * 25), 0) AS p25, coalesce(min(top) FILTER (bin > 0 AND (upto - zero) * 100 >= (total - zero) * 75), 0) AS p75 FROM
      (SELECT {keys}, bin, CASE WHEN bin < 64 THEN bin ELSE (((bin & 4294967295) + 1) << (bin >> 32)::int) - 1 END AS top, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total,
       coalesce(sum(n) FILTER (bin = 0) OVER (PARTITION BY {keys}), 0) AS zero FROM (SELECT {keys}, bin, count(*) AS n FROM e GROUP BY {keys}, bin)) GROUP BY {keys})"""


_PICK = lambda q: f"CASE WHEN o.total >= {MIN_GROUP} THEN o.{q} WHEN l.total >= {MIN_GROUP} THEN l.{q} ELSE a.{q} END"

OP9 = f"""WITH d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
  win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 7), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
  rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS j FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY 1),
  s AS MATERIALIZED (SELECT d.doc_id, lang, source, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint AS n_symbols, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id)),
  r AS MATERIALIZED (SELECT *, {', '.join(f'{_RATE(c)} AS {n}' for n, c in _RATES.items())} FROM s),
  e AS MATERIALIZED (SELECT lang, source, signal, CASE WHEN v < 64 THEN v ELSE ((length(bin(v)) - 6)::bigint << 32) + (v >> (length(bin(v)) - 6)) END AS bin
    FROM ({' UNION ALL '.join(f"SELECT lang, source, '{n}' AS signal, {n}::bigint AS v FROM r" for n in _RATES)})),
  picked AS (SELECT o.lang, o.source, o.signal, {', '.join(f'{_PICK(q)} AS {q}' for q in ('q50', 'q75', 'q90', 'p25', 'p75'))}
    FROM {_quantiles('lang, source')} o JOIN {_quantiles('lang')} l ON o.lang IS NOT DISTINCT FROM l.lang AND o.signal = l.signal JOIN {_quantiles('')} a ON o.signal = a.signal),
  tops AS (SELECT lang, source, signal, greatest(q90, CASE WHEN q75 > q50 THEN q75 + {SPREAD} * (q75 - q50) ELSE p75 + ((p75 - p25) * 3) // 2 END) AS top FROM picked),
  h AS (SELECT lang, source, {', '.join(f"max(top) FILTER (signal = '{n}')::bigint AS max_{n}" for n in _RATES)} FROM tops GROUP BY 1, 2),
  j AS (SELECT r.*, {', '.join(f'max_{n}' for n in _RATES)}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed
    FROM r LEFT JOIN h ON r.lang IS NOT DISTINCT FROM h.lang AND r.source IS NOT DISTINCT FROM h.source)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(f'{n} <= max_{n}' for n in _RATES)} AS kept, {', '.join(f'max_{n}' for n in _RATES)} FROM j"""

OP10 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
  win AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
  low AS (SELECT k, min(doc_id) AS first FROM win GROUP BY 1),
  gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM win JOIN low USING (k) WHERE doc_id > first),
  t AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM t ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
  n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
  SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n.n, 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES = {"op3_decontamination": OP3, "op4_chat_format": OP4, "op9_quality_rules": OP9, "op10_substring_dedup": OP10}
