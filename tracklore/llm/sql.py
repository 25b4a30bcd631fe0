"""DuckDB SQL of the queries whose rows SQL can express over whole tables."""

WORD = r"[^\x20\x09-\x0D]+"
BENCH = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))

QUALITY = rf"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT row, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
r AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
p AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY row),
l AS (SELECT row, line, count(*) AS c FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY ALL),
ld AS (SELECT row, sum(c) AS n_lines, sum(c - 1) AS n_dup_lines FROM l GROUP BY row),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(COALESCE(n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  COALESCE(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_ascii_letters,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words
  FROM w LEFT JOIN p USING (row) LEFT JOIN ld USING (row)),
b AS (SELECT *, CAST({{bits}} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {{base}} <> 0 AS base_failed, fail_bits & {{reject}} = 0 AS kept, fail_bits FROM b"""

DECONTAMINATION = rf"""WITH i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{BENCH}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS gram FROM (SELECT item_id, ws, LEAST(13, len(ws)) AS n, unnest(generate_series(1, len(ws) - LEAST(13, len(ws)) + 1)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '{BENCH}') AS ws FROM documents),
dw AS (SELECT row, n, k, array_to_string(ws[k:k + n - 1], ' ') AS gram FROM (SELECT row, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT row, k, n, item_id FROM dw JOIN iw USING (n, gram)),
c AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(generate_series(k, k + n - 1)) AS place FROM h) GROUP BY row),
s AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN c USING (row) LEFT JOIN s USING (row)"""

WARC = """WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS hex, count(*) OVER same AS n, min(page_id) OVER same AS first FROM pages WINDOW same AS (PARTITION BY COALESCE(html, ''))),
r AS (SELECT *, COALESCE(n > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first, false) AS again FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(generate_series(0, 31),
  lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""


def quality(rules: dict[str, str], base: int, reject: int) -> str:
    bits = " + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, cond in enumerate(rules.values()))
    return QUALITY.format(bits=bits, base=base, reject=reject)



def _remainder(c: int, steps: int) -> int:
    return c if not steps else _remainder(c >> 1 ^ (0xEDB88320 if c & 1 else 0), steps - 1)


def crc32(text: str) -> str:
    """Unsigned crc32 of a VARCHAR expression, by the hexadecimal digits of its bytes (the lower digit of a byte first)."""
    table = [_remainder(c, 4) for c in range(16)]
    digits = f"list_transform(generate_series(0, 2 * strlen({text}) - 1), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(i + 2 - 2 * (i % 2) AS BIGINT), 1) AS BIGINT))"
    return f"xor(list_reduce({digits}, lambda crc, d: xor(crc >> 4, {table}[1 + xor(crc & 15, d)]), 4294967295), 4294967295)"


SPELLING = rf"""WITH RECURSIVE r AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT id || ':' || run AS name, run, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT run, c, {crc32("name")} AS h FROM c),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(generate_series(0, length(word) - 1)) AS i FROM v)),
e AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
m AS (SELECT a, b AS form, v.n AS best, count(*) OVER (PARTITION BY a) AS n_near FROM e JOIN v ON b = v.word QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
f AS (SELECT word, n, COALESCE(n_near, 0) AS n_near, CASE WHEN best >= 5 * n THEN form END AS form, CASE WHEN best >= 5 * n THEN best END AS form_n FROM v LEFT JOIN m ON word = a),
u AS (SELECT word, form AS top, form_n AS top_n FROM f WHERE form IS NOT NULL UNION ALL SELECT u.word, f.form, f.form_n FROM u JOIN f ON u.top = f.word WHERE f.form IS NOT NULL)
SELECT word, form, COALESCE((SELECT arg_max(top, top_n) FROM u WHERE u.word = f.word), word) AS root, n, n_near, form_n FROM f"""


def merkle(depth: int = 6, over: int = 4, fan: int = 16) -> str:
    """The manifest of up to fan ** depth rows a source and fan ** over sources, a level of nodes at a time."""
    written = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(written(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    out = [f"""l AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(lower)} END AS changed FROM documents),
n0 AS (SELECT doc_id, leaf, COALESCE(changed, leaf) AS given, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS m, leaf AS d FROM l)"""]

    def levels(n: str, many: int) -> None:
        for k in range(many):
            out.append(f"{n}{k + 1} AS (SELECT g, place // {fan} AS place, (m + {fan - 1}) // {fan} AS m, sha256(string_agg(d, '' ORDER BY place)) AS d FROM {n}{k} WHERE m > 1 GROUP BY ALL)")
        for k in range(many):
            run = f"(PARTITION BY g, place // {fan} ORDER BY place"
            out.append(f"""{n}s{k} AS (SELECT g, place, COALESCE(string_agg(d, '') OVER {run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  COALESCE(string_agg(d, '') OVER {run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM {n}{k} WHERE m > 1)""")

    tops = lambda n, many: " UNION ALL ".join(f"SELECT g, d FROM {n}{k} WHERE m = 1" for k in range(many + 1))
    levels("n", depth)
    out.append(f"t AS ({tops('n', depth)}), t0 AS (SELECT 0 AS g, g AS place, count(*) OVER () AS m, d FROM t)")
    levels("t", over)
    out.append(f"root AS (SELECT d AS root FROM ({tops('t', over)}))")
    out.append("p0 AS (SELECT doc_id, leaf, g, place, given AS own, '' AS proof FROM n0)")
    steps = [(f"ns{k}", f"p.g = s.g AND p.place // {fan ** k} = s.place") for k in range(depth)] + [(f"ts{k}", f"p.g // {fan ** k} = s.place") for k in range(over)]
    for k, (level, on) in enumerate(steps):
        out.append(f"p{k + 1} AS (SELECT doc_id, leaf, p.g, p.place, CASE WHEN a IS NULL THEN own ELSE sha256(a || own || z) END AS own, proof || COALESCE(a || z, '') AS proof FROM p{k} p LEFT JOIN {level} s ON {on})")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, t.d AS subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified FROM p{len(steps)} JOIN t USING (g), root"
