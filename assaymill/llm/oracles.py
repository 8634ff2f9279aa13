"""DuckDB SQL that recomputes queries of the numbered operators where SQL can express them."""

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM w
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (nx + ny - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""


def op1() -> str:
    """The counts, and the same concentration steps as unrolled common table expressions."""
    from assaymill.llm import quality_rules as q

    p = range(q.P)
    low = [(i, j) for i in p for j in range(i + 1)]
    trim = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ctes = [
        rf"""w AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {trim}) <> '') AS lines FROM documents)""",
        """spans AS (SELECT r, unnest(range(1, len(ws) - 6)) AS pos, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS span FROM w WHERE len(ws) >= 8)""",
        """twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, span) AS c FROM spans) WHERE c > 1)""",
        """covered AS (SELECT r, sum(k) AS n FROM (SELECT r, least(8, coalesce(lead(pos) OVER (PARTITION BY r ORDER BY pos) - pos, 8)) AS k FROM twice) GROUP BY r)""",
        r"""counts AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (r))""",
        f"""v0 AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           round(ln(word_chars / nullif(n_words, 0)) * {q.SCALE}) AS x0, round(ln(1 + 100 * n_symbols / nullif(word_chars, 0)) * {q.SCALE}) AS x1,
           round(n_dup_lines / greatest(n_lines, 1) * {q.SCALE}) AS x2, round(n_repeat_words / nullif(n_words, 0) * {q.SCALE}) AS x3 FROM counts)""",
        """tallies AS (SELECT lang, source, count(*) AS fine, sum(count(*)) OVER (PARTITION BY lang) AS coarse, sum(count(*)) OVER () AS total FROM v0 WHERE NOT base_failed GROUP BY lang, source)""",
        """v AS (SELECT v0.*, CASE WHEN fine >= 50 THEN struct_pack(k := 2, l := v0.lang, s := v0.source) WHEN coarse >= 50 THEN struct_pack(k := 1, l := v0.lang, s := NULL::VARCHAR)
           WHEN total >= 50 THEN struct_pack(k := 0, l := NULL::VARCHAR, s := NULL::VARCHAR) END AS cell
           FROM v0 LEFT JOIN tallies t ON v0.lang IS NOT DISTINCT FROM t.lang AND v0.source IS NOT DISTINCT FROM t.source)""",
        "u AS (SELECT * FROM v WHERE NOT base_failed AND cell IS NOT NULL)",
        "med AS (SELECT cell, " + ", ".join(f"quantile_disc(x{i}, 0.5) AS m{i}" for i in p) + " FROM u GROUP BY cell)",
        "mad AS (SELECT u.cell AS cell, " + ", ".join(f"quantile_disc(abs(x{i} - m{i}), 0.5) AS d{i}" for i in p) + " FROM u JOIN med ON u.cell = med.cell GROUP BY u.cell)",
        "e0 AS (SELECT med.cell AS cell, " + ", ".join(f"m{i}" for i in p) + ", " + ", ".join(f"sqrt((d{i} * 1.4826) ** 2 + {(q.FLOOR[i] * q.SCALE) ** 2})::DOUBLE AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}" for i, j in low) + " FROM med JOIN mad ON med.cell = mad.cell)",
    ]

    def distance(name: str, rows: str, estimate: str) -> None:
        source = f"(SELECT {rows}.*, {', '.join(f'm{i}' for i in p)}, {', '.join(f'l{i}{j}' for i, j in low)} FROM {rows} LEFT JOIN {estimate} e ON {rows}.cell = e.cell)"
        for i in p:
            z = f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i}"
            source = f"(SELECT *, {z} AS z{i} FROM {source})"
        ctes.append(f"{name} AS (SELECT *, {' + '.join(f'z{i} * z{i}' for i in p)} AS d2 FROM {source})")

    def estimate(name: str, rows: str, factor: float) -> None:
        source = f"(SELECT cell, count(*)::DOUBLE AS n, {', '.join(f'sum(x{i}) AS s{i}' for i in p)}, {', '.join(f'sum(x{i} * x{j}) AS ss{i}{j}' for i, j in low)} FROM {rows} GROUP BY cell)"
        source = f"(SELECT *, {', '.join(f's{i} / n AS m{i}' for i in p)} FROM {source})"
        for i, j in low:
            cov = f"{factor!r} * (ss{i}{j} / n - m{i} * m{j})"
            cov = f"greatest({cov}, 0.0) + {(q.FLOOR[i] * q.SCALE) ** 2!r}" if i == j else cov
            cov += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            source = f"(SELECT *, {f'sqrt(greatest({cov}, 1.0))' if i == j else f'({cov}) / l{j}{j}'} AS l{i}{j} FROM {source})"
        ctes.append(f"{name} AS (SELECT cell, {', '.join(f'm{i}' for i in p)}, {', '.join(f'l{i}{j}' for i, j in low)} FROM {source})")

    for s in range(q.STEPS):
        distance(f"d{s}", "u", f"e{s}")
        ctes.append(f"b{s} AS (SELECT *, floor({q.BINS} * ln(d2 + 1e-6)) AS bin FROM d{s})")
        ctes.append(f"c{s} AS (SELECT cell, bin, sum(count(*)) OVER (PARTITION BY cell ORDER BY bin) - count(*) AS before, sum(count(*)) OVER (PARTITION BY cell) AS total FROM b{s} GROUP BY cell, bin)")
        ctes.append(f"h{s} AS (SELECT b.* FROM b{s} b JOIN c{s} c ON b.cell = c.cell AND b.bin = c.bin WHERE before < {q.RAW_SHARE} * total)")
        estimate(f"e{s + 1}", f"h{s}", q.consistency(q.RAW_SHARE))
    value = ", ".join([*(f"m{i}" for i in p), *(f"l{i}{j}" for i, j in low)])
    root = " + ".join(f"ln(l{i}{i})" for i in p)
    ctes.append("steps AS (" + " UNION ALL ".join(f"SELECT *, round({root}, 6) AS root, {s} AS step FROM e{s + 1}" for s in range(q.STEPS)) + ")")
    ctes.append(f"em AS (SELECT cell, {value} FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY root, step) AS best FROM steps) WHERE best = 1)")
    distance("dr", "u", "em")
    ctes.append(f"good AS (SELECT * FROM dr WHERE d2 <= {q.chi_square_quantile(q.CUT, q.P)!r})")
    estimate("ef", "good", q.consistency(q.CUT))
    distance("df", "v", "ef")
    return (
        "WITH "
        + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in ctes)
        + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(d2 > {q.chi_square_quantile(0.9999, q.P)!r}, false) AS kept FROM df"
    )


#: CRC-32 of a text's ASCII characters, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda i: i::BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP12 = rf"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
taken AS (SELECT i.conv_id, o.n AS d, o.k, o.words FROM ids i JOIN own o ON o.conv_id = i.base AND o.n <= i.h),
seqs AS (
  SELECT conv_id, d, k, words FROM taken
  UNION ALL
  SELECT o.conv_id, o.n - i.h + (SELECT count(*) FROM taken t WHERE t.conv_id = o.conv_id), o.k, o.words FROM own o JOIN ids i USING (conv_id) WHERE o.n > i.h
), paths AS (
  SELECT conv_id, 0 AS d, '' AS p, 0 AS words FROM ids
  UNION ALL
  SELECT conv_id, d, sha256(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY d)), words FROM seqs
), sized AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS len FROM paths),
nodes AS (
  SELECT d, p, min(conv_id) AS name, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256
  FROM sized GROUP BY d, p
), linked AS (
  SELECT n.*, a.p AS above, b.name AS parent FROM nodes n LEFT JOIN paths a ON a.conv_id = n.name AND a.d = n.d - 1 LEFT JOIN nodes b ON b.d = a.d AND b.p = a.p
), counted AS (SELECT l.*, (SELECT count(*) FROM linked c WHERE c.d = l.d + 1 AND c.above = l.p) AS n_children FROM linked l),
below AS (
  SELECT a.d, a.p, sum((c.n_children = 0)::BIGINT) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
  FROM counted c JOIN paths a ON a.conv_id = c.name AND a.d <= c.d GROUP BY 1, 2
)
SELECT c.name AS conv_id, c.d AS depth, c.parent AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.d = c.d AND b.p = c.p
"""
