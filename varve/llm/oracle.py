"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from varve.llm import importance, mixing, quality_rules, secrets
from varve.llm.words import SYMBOLS_RATIO_CHARS

_BLANK = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '')"


def op4() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    value = {
        "n_words": "n_words",
        "repeat_ratio": "coalesce(n_repeat_words / nullif(n_words, 0), 0)",
        "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0), 0)",
        "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0)",
        "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
        "stop_ratio": "coalesce((n_stop + 1) / nullif(n_words, 0), 0)",
        "upper_ratio": "coalesce(n_upper / nullif(word_chars, 0), 0)",
    }
    tests = [f"{value[r.measure]} >= {r.low}::DOUBLE" for r in quality_rules.RULES if r.low is not None]
    tests += [f"{value[r.measure]} <= {r.high}::DOUBLE" for r in quality_rules.RULES if r.high is not None]
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_BLANK}', '', 'g') <> '') AS l FROM documents),
  g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
  r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
  c AS (SELECT rid, sum(least(5, step)) AS n FROM (SELECT rid, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5) AS step FROM r) GROUP BY rid),
  m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper FROM d LEFT JOIN c USING (rid)),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM f"""


def op5() -> str:
    odd = SYMBOLS_RATIO_CHARS.replace("'", "''")
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    draw = "(('0x' || substr(md5({0}), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656::DOUBLE"
    by_id = draw.format(f"'{mixing.SEED}|' || doc_id::VARCHAR")
    by_text = draw.format(f"'{mixing.SEED}|' || md5(coalesce(text, ''))")
    return f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, coalesce(text, '') AS text FROM documents),
  k AS (SELECT doc_id, source, size, -ln(CASE WHEN doc_id IS NULL THEN {by_text} ELSE {by_id} END)
    / greatest(0.1::DOUBLE, 1 - (length(text) - length(translate(text, '{odd}', ''))) / greatest(size, 1)) AS key FROM d),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM k GROUP BY source),
  w AS (SELECT *, [{weights}][(rank - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {float(mixing.MAX_EPOCHS)}::DOUBLE AS cap FROM s),
  l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
    WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  v AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM l WHERE level * weight <= cap),
  t AS (SELECT l.source, source_size, CASE WHEN v.level IS NULL THEN cap ELSE least(cap, v.level * weight) END AS target FROM l, v),
  p AS (SELECT k.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
  e AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-9) AS epochs FROM p)
  SELECT doc_id, size, source_size, target, (size * least({mixing.MAX_EPOCHS}, epochs + CASE WHEN size > 0 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM e"""


def op7() -> str:
    order = "ORDER BY turn NULLS LAST, role, raw"
    safe = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
    last = r"regexp_replace(role, '<(\\*)(\||\z)', '<\\\1\2', 'g')"
    name = rf"regexp_replace({last}, '\|(\\*)>', '|\\\1>', 'g')"
    return f"""WITH q AS (SELECT conv_id, floor(turn / 256)::BIGINT AS piece, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw FROM conversations),
  r AS (SELECT *, {name} AS name, {safe.format("raw")} AS text, floor((row_number() OVER (PARTITION BY conv_id, piece {order}) - 1) / 1024)::BIGINT AS part FROM q),
  s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
  j AS (SELECT r.*, speaker, '<|' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || name END || '|>' || chr(10) AS head
    FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
  p AS (SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, speaker, piece, part {order} ROWS UNBOUNDED PRECEDING) AS e FROM j)
  SELECT conv_id, speaker, piece, part, count(*) AS n_messages, string_agg(head || text || '<|end|>' || chr(10), '' {order}) AS text,
    coalesce(string_agg(CASE WHEN role = speaker THEN (e - length(text) - 8)::VARCHAR || ':' || e::VARCHAR END, ',' {order}), '') AS mask_spans FROM p GROUP BY conv_id, speaker, piece, part"""


def op8() -> str:
    quoted = lambda p: p.replace("'", "''")
    kinds = [*secrets.BASE, *secrets.MORE]
    parts = " UNION ALL ".join(
        f"SELECT rid, {i} AS rank, '{k.name}' AS kind, {k.least} AS least, {int(k.bare)} AS bare, string_split_regex({body}, '{quoted(k.pattern)}') AS p, "
        f"regexp_extract_all({body}, '{quoted(k.pattern)}') AS m, regexp_extract_all({body}, '{quoted(k.pattern)}', {k.group}) AS v FROM d"
        for i, k in enumerate(kinds)
        for body in ["chr(10) || text" if k.bare else "text"]
    )
    listed = "string_agg(kind || ':' || s::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY s, rank)"
    n = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in secrets.BASE)
    back = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in secrets.BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents), k AS ({parts}),
  i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
  a AS (SELECT rid, rank, kind, v[i] AS value, least, bare, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS e, length(m[i]) AS n FROM i),
  f AS (SELECT rid, rank, kind, value, (e - CASE WHEN bare = 1 THEN length(value) + 1 ELSE n END)::BIGINT AS s, (e - bare)::BIGINT AS e FROM a WHERE length(value) >= least),
  o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) >= {secrets.EXAMPLE_OWNERS} OR count(DISTINCT coalesce(source, chr(0))) >= 2 AND count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= {secrets.EXAMPLE_REPOSITORIES} AS shared FROM f JOIN d USING (rid) GROUP BY value),
  c AS (SELECT rid, {n}, sha256(coalesce({listed} FILTER (WHERE rank < {len(secrets.BASE)}), '')) AS base_sha256, {listed} AS spans, {listed} FILTER (WHERE NOT shared) AS live_spans,
    count(DISTINCT value) FILTER (WHERE NOT shared) AS n_live, count(DISTINCT value) FILTER (WHERE shared) AS n_example FROM f JOIN o USING (value) GROUP BY rid)
  SELECT doc_id, {back}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live_spans, '') AS live_spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN c USING (rid)"""


def op11() -> str:
    """A CRC-32 is linear: each byte adds its table entry carried over the bytes after it, and the length adds a constant."""
    n = importance.BUCKETS
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = f"translate(coalesce(text, ''), '{upper}', '{lower}')"
    found = rf"regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " UNION ALL ".join(f"SELECT rid, kind, array_to_string(w[i:i + {k}], ' ') AS f FROM (SELECT rid, kind, w, unnest(range(1, len(w) - {k} + 1)) AS i FROM d)" for k in range(importance.DEPTH))
    step = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM (SELECT 'raw' AS kind, doc_id, {found} AS w FROM documents UNION ALL SELECT 'target', NULL, {found} FROM benchmark)),
  r AS MATERIALIZED ({runs}),
  u AS MATERIALIZED (SELECT DISTINCT f, hex(encode(f)) AS h, strlen(f) AS n FROM r),
  bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, {step.format("c")}, k + 1 FROM bits WHERE k < 8),
  crc AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
  far(b, c, k) AS (SELECT b, c, 0 FROM crc UNION ALL SELECT far.b, xor(far.c // 256, crc.c), k + 1 FROM far JOIN crc ON crc.b = far.c % 256 WHERE k < (SELECT max(n) FROM u)),
  zero(c, k) AS (SELECT 4294967295::BIGINT, 0 UNION ALL SELECT xor(zero.c // 256, crc.c), k + 1 FROM zero JOIN crc ON crc.b = zero.c % 256 WHERE k < (SELECT max(n) FROM u)),
  bytes AS (SELECT f, n - 1 - i AS k, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AS b FROM (SELECT f, h, n, unnest(range(n)) AS i FROM u)),
  sums AS (SELECT f, bit_xor(far.c) AS c, count(*) AS n FROM bytes JOIN far USING (b, k) GROUP BY f),
  bucket AS MATERIALIZED (SELECT f, xor(xor(sums.c, zero.c), 4294967295) % {n} AS bucket FROM sums JOIN zero ON zero.k = sums.n),
  held AS (SELECT bucket, count(*) FILTER (kind = 'raw') AS s, count(*) FILTER (kind = 'target') AS t FROM r JOIN bucket USING (f) GROUP BY bucket),
  whole AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM held),
  gain AS (SELECT bucket, floor(1000 * ln((held.t + 1)::DOUBLE * (whole.s + {n}) / ((held.s + 1)::DOUBLE * (whole.t + {n}))))::BIGINT AS gain FROM held, whole),
  weighed AS (SELECT rid, sum(gain)::BIGINT AS weight, count(*) AS n FROM r JOIN bucket USING (f) JOIN gain USING (bucket) GROUP BY rid),
  scored AS (SELECT doc_id, len(w) >= {importance.LEAST_WORDS} AS drawable, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weighed USING (rid) WHERE kind = 'raw'),
  placed AS (SELECT *, row_number() OVER (ORDER BY drawable DESC, score DESC, doc_id) AS place, count(*) FILTER (drawable) OVER () AS many FROM scored)
  SELECT doc_id, n_features, weight, score, CASE WHEN place <= {importance.PERCENT} * many // 100 THEN place END AS rank FROM placed"""
