"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from routelore.llm import merkle, mixing, resampling, url_filter
from routelore.llm.shared import LOWER, UPPER

OP2 = """
WITH own AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
same AS (SELECT payload_digest, payload_bytes, max(page_id) AS response FROM own WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM own LEFT JOIN same USING (payload_digest, payload_bytes)
"""


def op6() -> str:
    """The raking unrolled: one table per update."""
    keys = ", ".join(mixing.KEYS)
    parts = [f"""marked AS (SELECT doc_id, source AS own_source, lang AS own_lang, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {mixing.TOPIC_SQL} AS topic,
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents)""",
             f"counted AS (SELECT {keys}, sum(tokens)::BIGINT AS tokens FROM marked GROUP BY {keys})",
             f"w0 AS MATERIALIZED (SELECT *, weight / {mixing.FRACTION}::DOUBLE AS most FROM (SELECT *, coalesce(tokens / nullif((SELECT sum(tokens) FROM counted), 0)::DOUBLE, 0) AS weight FROM counted))"]
    for k in mixing.KEYS:
        parts.append(f"t_{k}_0 AS MATERIALIZED (SELECT {k}, coalesce(part / nullif(sum(part) OVER (), 0), 0) AS target, most FROM (SELECT {k}, pow(sum(weight), {mixing.POWERS[k]}) AS part, sum(most) AS most FROM w0 GROUP BY {k}))")
        for i in range(mixing.FILLS):
            parts.append(f"""t_{k}_{i + 1} AS MATERIALIZED (SELECT {k}, CASE WHEN target >= most THEN most ELSE target * coalesce((1 - coalesce(sum(most) FILTER (target >= most) OVER (), 0)) / nullif(sum(target) FILTER (target < most) OVER (), 0), 0) END AS target, most FROM t_{k}_{i})""")
        parts.append(f"t_{k} AS MATERIALIZED (SELECT {k}, least(target, most) AS target FROM t_{k}_{mixing.FILLS})")
    full = "weight >= most * (1 - 1e-12::DOUBLE)"
    n = 0
    for _ in range(mixing.SWEEPS):
        for k in mixing.KEYS:
            parts.append(f"""r{n + 1} AS MATERIALIZED (SELECT {k}, CASE WHEN target > now THEN CASE WHEN now > held THEN (target - held) / (now - held) ELSE 1 END ELSE coalesce(target / nullif(now, 0), 0) END AS ratio
              FROM (SELECT {k}, sum(weight) AS now, sum(CASE WHEN {full} THEN weight ELSE 0 END) AS held FROM w{n} GROUP BY {k}) JOIN t_{k} USING ({k}))""")
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT {keys}, tokens, most, CASE WHEN {full} AND ratio > 1 THEN weight ELSE least(weight * ratio, most) END AS weight FROM w{n} JOIN r{n + 1} USING ({k}))")
            n += 1
    parts.append(f"chances AS (SELECT {keys}, CASE WHEN tokens > 0 THEN least(1.0, weight / most) ELSE 1.0 END AS p FROM w{n})")
    uniform = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(16, 13)"
    return f"""WITH {", ".join(parts)}
SELECT doc_id, own_source AS source, own_lang AS lang, topic, marked.tokens, round(p, 9) AS probability, {uniform} < p AS sampled
FROM marked JOIN chances USING ({keys})"""


def op9() -> str:
    u = url_filter
    rule = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}" for _, h, p in sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    names = [f"'{h}{p}'" for _, h, p in sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))]
    kinds = [f"'{k}'" for k, h, p in sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))]
    parts = [f"""own AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
      CASE WHEN contains(url, '://') THEN regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM (SELECT *, substr(url, instr(url, '://') + 3) AS rest FROM pages))""",
             """bads AS (SELECT doc_id AS number, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)""",
             "known AS (SELECT own.*, bad FROM own LEFT JOIN bads ON number = try_cast(nullif(regexp_extract(path, '^/[a-z][a-z]/([0-9]{1,18})', 1), '') AS BIGINT))",
             """hosts AS MATERIALIZED (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix,
      count(bad)::DOUBLE AS pages, coalesce(sum(bad), 0)::DOUBLE AS bad FROM known GROUP BY host)""",
             f"m0 AS (SELECT coalesce(sum(pages), 0) AS up_pages, coalesce(sum(bad), 0) AS up_bad, {u.PRIOR_BAD + u.PRIOR_GOOD}::DOUBLE AS up_strength, {u.PRIOR_BAD / (u.PRIOR_BAD + u.PRIOR_GOOD)}::DOUBLE AS up_mean FROM hosts)"]
    for depth, level in enumerate(u.LEVELS):
        keys, up = ", ".join(u.LEVELS[: depth + 1]), ", ".join(u.LEVELS[:depth])
        join = f"JOIN m{depth} USING ({up})" if depth else "CROSS JOIN m0"
        parts.append(f"""n{depth} AS MATERIALIZED (SELECT {keys}, pages, bad, (up_bad - bad + up_strength * up_mean) / (up_pages - pages + up_strength) AS parent
          FROM (SELECT {keys}, sum(pages) AS pages, sum(bad) AS bad FROM hosts GROUP BY {keys}) {join})""")
        parts.append(f"""s{depth} AS (SELECT round(CASE WHEN extra > 0 THEN greatest({u.WEAKEST}, least({u.STRONGEST}, scale / extra - 1)) ELSE {u.STRONGEST} END, 6) AS strength
          FROM (SELECT sum(pow(bad - pages * parent, 2) - pages * parent * (1 - parent)) AS extra, sum(pages * (pages - 1) * parent * (1 - parent)) AS scale FROM n{depth}))""")
        parts.append(f"m{depth + 1} AS MATERIALIZED (SELECT {keys}, pages AS up_pages, bad AS up_bad, strength AS up_strength, parent AS up_mean FROM n{depth} CROSS JOIN s{depth})")
    parts.append("final AS (SELECT host, up_pages, up_strength, (up_bad + up_strength * up_mean) / (up_pages + up_strength) AS mean FROM m3)")
    return f"""WITH {", ".join(parts)}
SELECT page_id, host, path, {rule.format(*names)} AS rule,
  coalesce({rule.format(*kinds)}, CASE WHEN mean - {u.DEVIATIONS} * sqrt(mean * (1 - mean) / (up_pages + up_strength + 1)) > {u.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM known JOIN final USING (host)"""


#: A list of the 256 steps of CRC-32, made from its polynomial.
CRC_STEPS = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS steps FROM (SELECT unnest(range(256))::BIGINT AS i)"


def crc32(codes: str) -> str:
    """Unsigned CRC-32 of a list of byte values, given the column ``steps``."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


def op11(levels: int = 16) -> str:
    """The two trees unrolled, one table per level; ``levels`` of arity three are enough for 43 million leaves."""
    arity = merkle.ARITY
    spelled = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(spelled, merkle.FIELDS[:-1]), spelled(text)]) + ")"
    even = crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)") + " % 2 = 0"
    parts = [f"crc AS ({CRC_STEPS})",
             f"""own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
               FROM (SELECT doc_id, coalesce(':' || source, '') AS tree, {leaf("text")} AS h, CASE WHEN doc_id IS NOT NULL AND {even} THEN {leaf("replace(text, chr(10), '')")} END AS other FROM documents, crc))""",
             "a0 AS MATERIALIZED (SELECT tree, pos, n, h FROM own)",
             "c0 AS MATERIALIZED (SELECT doc_id, tree, pos, h AS leaf, coalesce(other, h) AS acc, '' AS sib FROM own)"]

    def climb(a: str, c: str) -> None:
        for j in range(levels):
            run = f"PARTITION BY tree, pos // {arity} ORDER BY pos"
            parts.append(f"""{a}s{j} AS MATERIALIZED (SELECT tree, pos, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a}{j} WHERE n > 1)""")
            parts.append(f"""{a}{j + 1} AS MATERIALIZED (SELECT tree, pos // {arity} AS pos, (n + {arity - 1}) // {arity} AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {a}{j} WHERE n > 1 GROUP BY tree, pos // {arity}, n
              UNION ALL SELECT tree, pos, n, h FROM {a}{j} WHERE n = 1)""")
            parts.append(f"""{c}{j + 1} AS MATERIALIZED (SELECT x.* REPLACE (CASE WHEN l IS NULL THEN acc ELSE sha256(l || acc || r) END AS acc, sib || coalesce(l || r, '') AS sib, x.pos // {arity} AS pos)
              FROM {c}{j} x LEFT JOIN {a}s{j} s ON x.tree = s.tree AND x.pos = s.pos)""")

    climb("a", "c")
    parts.append(f"subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a{levels})")
    parts.append("b0 AS MATERIALIZED (SELECT '' AS tree, pos, n, h FROM subroots)")
    parts.append(f"d0 AS MATERIALIZED (SELECT doc_id, leaf, s.h AS subroot, acc, sib, '' AS tree, s.pos AS pos FROM c{levels} x JOIN subroots s ON x.tree = s.tree)")
    climb("b", "d")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = h AS verified FROM d{levels} CROSS JOIN (SELECT h FROM b{levels})"""


def op12() -> str:
    u = resampling
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    codes = "list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)"
    return f"""WITH crc AS ({CRC_STEPS}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS words FROM documents),
seen AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM docs) GROUP BY r, w),
aims AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({words}) AS w FROM benchmark) GROUP BY w),
named AS MATERIALIZED (SELECT w, {crc32(codes)} % {u.BUCKETS} AS bucket FROM (SELECT w FROM seen UNION SELECT w FROM aims), crc),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM seen JOIN named USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM aims JOIN named USING (w) GROUP BY bucket),
gains AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {u.BUCKETS}))::DOUBLE / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {u.BUCKETS}))::DOUBLE))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM seen JOIN named USING (w) JOIN gains USING (bucket) GROUP BY r),
scores AS MATERIALIZED (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('{u.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank, count(*) OVER () AS many FROM scores WHERE n_features >= {u.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {u.PERCENT} * many // 100 THEN rank END AS rank FROM scores LEFT JOIN ranks USING (r)"""
