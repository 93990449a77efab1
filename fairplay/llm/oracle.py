"""DuckDB SQL of the registered queries that SQL can express: searches (1), quality
(3), sharding (4), mixing (7), importance resampling (11), exact dedup (12) and the
manifest (13). The others work on bytes, hashes or tokenizers
that SQL does not have; ``tests/llm`` holds them against brute force."""

from __future__ import annotations


from fairplay.llm import quality, sharding

WORD = r"[^\x20\x09-\x0D]+"
SIZE = f"CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT)"

TOP_K = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 100 = 0),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


def sharding_sql(seed: int, shards: int) -> str:
    def permuted(value: str, name: str, source: str) -> str:
        """Nested selects of the half rounds over ``source``, which has t, a and b."""
        q = f"SELECT * EXCLUDE ({value}), {value} % a AS x, {value} // a AS y FROM {source}"
        for i, k in enumerate(sharding.round_keys(seed)):
            f = lambda v: f"((({v} * {k[0]} + {k[1]}) % {sharding.P1}) * {k[2]} % {sharding.P2})"  # noqa: B023, E731
            new = f"x, (y + {f('x')}) % b AS y" if i % 2 else f"(x + {f('y')}) % a AS x, y"
            q = f"SELECT * EXCLUDE (x, y), {new} FROM ({q})"
        return f"SELECT * EXCLUDE (x, y), y * a + x AS {name} FROM ({q})"

    step = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, {})"
    return f"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda n: {step.format("CAST(n AS BIGINT)")}) AS t),
docs AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
           list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
             lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INTEGER) + 1]), 4294967295) AS crc
         FROM documents, crc_table),
summed AS (SELECT doc_id, size, xor(crc, 4294967295) AS text_crc32 FROM docs),
numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), {sharding.BUCKET_DIGITS}),
           doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS v, count(*) OVER () AS t FROM summed),
sized AS (SELECT *, CAST(ceil(sqrt(t)) AS BIGINT) AS a, (t + CAST(ceil(sqrt(t)) AS BIGINT) - 1) // CAST(ceil(sqrt(t)) AS BIGINT) AS b FROM numbered),
walk AS (SELECT * FROM ({permuted("v", "v", "sized")})
  UNION ALL SELECT * FROM ({permuted("v", "v", "(SELECT * FROM walk WHERE v >= t)")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % {shards} AS INTEGER) AS shard, CAST(v // {shards} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM walk WHERE v < t"""


MIXING = f"""
WITH d AS (SELECT doc_id, source, {SIZE} AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight,
        source_size * 2.0::DOUBLE AS cap FROM s),
-- sources in the order in which a rising level reaches their caps; the last level that caps nothing more holds
o AS (SELECT *, coalesce(sum(cap) OVER k, 0) AS capped, sum(weight) OVER r AS open
      FROM w WINDOW k AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    r AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT min_by(level, cap / weight) AS level FROM (
        SELECT cap, weight, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - capped) / open AS level FROM o) WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM w, l),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto - size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x"""


def quality_sql() -> str:
    rules = list(quality.RULES.items())
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    ends = quality.ENDED.replace("\\x20\\x09-\\x0D", "\\x20\\x09-\\x0D")
    q = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l FROM documents),
grams AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
places AS (SELECT DISTINCT rid, i + k AS i FROM hits, (VALUES (0), (1), (2)) AS x(k)),
repeats AS (SELECT rid, count(*) AS n FROM places GROUP BY rid),
m AS (SELECT docs.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '{ends}'))) AS n_ended_lines,
    length(t) - length(regexp_replace(t, '\\p{{L}}+', '', 'g')) AS n_letters, length(t) AS n_chars,
    len(list_intersect(w, [{stops}])) AS n_stop_words, len(list_distinct(w)) AS n_distinct
  FROM docs LEFT JOIN repeats ON docs.rid = repeats.rid),
v AS (SELECT *, {", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{r}" for r, (good, bad) in rules)} FROM m),
patterns AS (SELECT {", ".join(f"v_{r}" for r, _ in rules)}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY ALL),
e0 AS (SELECT {quality.PRIOR}::DOUBLE AS prior, {", ".join(f"{quality.START[0]}::DOUBLE AS g_{r}, {quality.START[1]}::DOUBLE AS b_{r}" for r, _ in rules)})"""
    logit = "ln(prior / (1 - prior))" + "".join(
        f" + CASE v_{r} WHEN 1 THEN ln(g_{r} / (1 - b_{r})) WHEN -1 THEN ln((1 - g_{r}) / b_{r}) ELSE 0 END" for r, _ in rules)
    limit = lambda x: f"least(greatest({x}, {1 - quality.SURE!r}::DOUBLE), {quality.SURE}::DOUBLE)"
    for i in range(quality.ROUNDS):
        share = lambda r, v, p, start: limit(
            f"(sum(CASE WHEN v_{r} = {v} THEN n * {p} ELSE 0 END) + {quality.SMOOTH * start}::DOUBLE) / "
            f"(sum(CASE WHEN v_{r} <> 0 THEN n * {p} ELSE 0 END) + {quality.SMOOTH}::DOUBLE)")
        q += f""",
e{i + 1} AS MATERIALIZED (SELECT {limit("sum(n * p) / sum(n)")} AS prior, {", ".join(
            f"{share(r, 1, 'p', quality.START[0])} AS g_{r}, {share(r, -1, '(1 - p)', quality.START[1])} AS b_{r}" for r, _ in rules)}
  FROM (SELECT *, 1 / (1 + exp(-({logit}))) AS p FROM patterns, e{i}))"""
    return q + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 / (1 + exp(-({logit}))) >= 0.5 AS kept
FROM v, e{quality.ROUNDS}"""


CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(n AS BIGINT))) AS t)"""


def crc32(text: str) -> str:
    """SQL of a text's CRC-32; needs CRC_TABLE's ``t``."""
    return (f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT)), "
            "lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INTEGER) + 1]), 4294967295), 4294967295)")


FEATURES = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
IMPORTANCE = f"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS rid, doc_id, {FEATURES} AS words FROM documents),
source AS (SELECT rid, unnest(words) AS w FROM docs),
target AS (SELECT unnest({FEATURES}) AS w FROM benchmark),
vocabulary AS (SELECT w, {crc32("w")} % 10000 AS bucket FROM (SELECT w FROM source UNION SELECT w FROM target), crc_table),
s AS (SELECT bucket, count(*) AS n FROM source JOIN vocabulary USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN vocabulary USING (w) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM source) + 10000 AS DOUBLE)
    / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM target) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM vocabulary) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT rid, sum(gain) AS weight FROM source JOIN vocabulary USING (w) JOIN gains USING (bucket) GROUP BY rid),
scored AS (SELECT docs.rid, doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE)
      + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights ON docs.rid = weights.rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, rid) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS pool FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= pool * 10 // 100 THEN place END AS rank FROM ranked"""

EXACT = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS size,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY size DESC, doc_id NULLS LAST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def leaf(**other: str) -> str:
    """SQL of a row's digest; ``other``: expressions in place of columns."""
    cells = (f"CAST({other.get(c, c)} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", "text"))
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')" for x in cells) + ")"


def levels(name: str, source: str) -> str:
    """Recursive query ``name``: all nodes over ``source`` (g, level, pos, n, h)."""
    return f"""{name} AS (SELECT g, level, pos, n, h FROM {source}
  UNION ALL SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(next, ''))
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY pos) AS next FROM {name} WHERE n > 1) WHERE pos % 2 = 0)"""


def paths(name: str, source: str, nodes: str) -> str:
    """Recursive query ``name``: the rows of ``source`` (rid, g, level, pos, n, h, proof) on their way up."""
    return f"""{name} AS (SELECT rid, g, level, pos, n, h, proof FROM {source}
  UNION ALL SELECT w.rid, w.g, w.level + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM {name} w LEFT JOIN {nodes} s ON s.g = w.g AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)"""


MANIFEST = f"""
WITH RECURSIVE {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS g, {leaf()} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf(n_chars="n_chars + 1")} ELSE {leaf()} END AS given
  FROM documents, crc_table),
leaves AS MATERIALIZED (SELECT *, 0 AS level, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS n FROM docs),
{levels("all_low", "(SELECT *, leaf AS h FROM leaves)")},
low AS MATERIALIZED (SELECT * FROM all_low),
tops AS MATERIALIZED (SELECT g AS name, '' AS g, 0 AS level, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM low WHERE n = 1),
{levels("all_high", "tops")},
high AS MATERIALIZED (SELECT * FROM all_high),
{paths("up_low", "(SELECT *, given AS h, '' AS proof FROM leaves)", "low")},
{paths("up_high", "(SELECT u.rid, tops.g, tops.level, tops.pos, tops.n, u.h, u.proof FROM up_low u JOIN tops ON tops.name = u.g WHERE u.n = 1)", "high")}
SELECT doc_id, leaf, tops.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, u.h AS folded_root, u.h = root.h AS verified
FROM up_high u JOIN leaves ON leaves.rid = u.rid JOIN tops ON tops.name = leaves.g, (SELECT h FROM high WHERE n = 1) AS root
WHERE u.n = 1"""


SQL: dict[str, str] = {
    "op1_exact_top_k": TOP_K,
    "op3_weak_supervision_quality": quality_sql(),
    "op4_feistel_sharding": sharding_sql(4, 8),
    "op7_source_mixing": MIXING,
    "op11_importance_resampling": IMPORTANCE,
    "op12_exact_dedup": EXACT,
    "op13_merkle_manifest": MANIFEST,
}
