from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from routelore.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text=...):
    doc_id, own, lang, source = row
    own = own if text is ... else text
    return h(*map(enc, (doc_id, source, lang, None if row[1] is None else len(row[1]), own)))


def climb(nodes):
    """Root, and for each node the pairs of siblings before and after it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            lo = p - p % 3
            paths[k].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + 3])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], paths


def brute(rows, changed):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    low = lambda v, none: (v is not None, none if v is None else v)
    sources = sorted({r[3] for r in rows}, key=lambda s: low(s if s is None else s.encode(), b""))
    trees = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (low(r[0], 0), leaf(r))) for s in sources}
    subs = {s: climb([leaf(r) for r in own]) for s, own in trees.items()}
    root, tops = climb([subs[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for r, path in zip(trees[s], subs[s][1]):
            path = path + top
            acc = leaf(r, None if r[1] is None else r[1].replace("\n", "")) if r[0] is not None and changed(r[0]) else leaf(r)
            for a, b in path:
                acc = h(a, acc, b)
            out.append((r[0], leaf(r), subs[s][0], root, h(*[a + b for a, b in path]), acc, acc == root))
    return sorted(out, key=repr)


def found(docs):
    got = merkle.manifest(docs, F.col("doc_id") % 2 == 0, F.regexp_replace("text", "\n", ""))
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4, 81, 82], [243, 244, 1, 9], [700, 30, 3]])
def test_trees_equal_brute_force(spark, documents, sizes):
    rows = [(k * 1000 + i, f"text {i}\nof {k}" if i % 3 else f"text {i}", "en", f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    got = found(documents(rows))
    assert got == brute(rows, lambda i: i % 2 == 0)
    assert all(r[6] == (r[0] % 2 == 1 or "\n" not in next(x[1] for x in rows if x[0] == r[0])) for r in got)


def test_nulls_ties_and_repeated_rows(spark, documents):
    rows = [(None, "a\n", None, None), (None, "a\n", None, None), (5, None, "en", None), (5, "", "en", None), (4, "x" * 300_000, "en", "ü"), (4, "q\nr", "en", "z"), (4, "q\nr", "en", "z"), (4, "other\n", "en", "z"), (6, "n\n", None, "")]
    assert found(documents(rows)) == brute(rows, lambda i: i % 2 == 0)


def test_empty_table_and_clashing_columns(spark, documents):
    assert found(documents([])) == []
    rows = [(k, f"t{k}", "en", "s") for k in range(5)]
    names = ["tree", "digest", "place", "count", "row", "leaf", "root", "path", "block", "own", "other"]
    assert found(documents(rows).withColumns({c: F.lit(c) for c in names})) == brute(rows, lambda i: i % 2 == 0)


def test_long_source_needs_several_rounds(spark, documents):
    docs = spark.range(7000).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "IF(id % 100 = 0, 'b', 'a') AS source", "length(concat('t', id)) AS n_chars")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert found(docs) == brute(rows, lambda i: i % 2 == 0)
