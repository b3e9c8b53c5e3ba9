"""Operators 11, 12 and 13 against brute force."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm.op06_token_orc import TokenConfig
from graphloom.llm.op11_vector_codes import Cells, CodeConfig, decoded, fingerprint, vector_codes
from graphloom.llm.op12_packing import PackConfig, binary_lengths, op12_packing, packed_digest, read_packed, write_packed
from graphloom.llm.op13_hard_negatives import Best, MiningConfig, hard_negatives, products

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
#: The names that the operators use inside.
CLASH = ["id", "vec", "code", "error", "of", "salt", "task", "block", "rank", "score"]


def vectors(rng, n, width=16, labels=4):
    return [(i, [rng.gauss(i % labels, 1.0) for _ in range(width)], i % labels) for i in range(n)]


def odd_vectors(width=16):
    zero = [0.0] * width
    return [
        (1000, None, 1), (1001, [NAN] + zero[1:], 1), (1002, [INF] + zero[1:], 1), (1003, [None] + zero[1:], 1),  # no whole vector
        (1004, zero, None), (1005, zero, None), (1100, zero, 2), (1006, [], 2), (1007, [1.5], 2),  # null labels, ties, short ones
        (1008, [-0.1] * width, 3), (1008, [-0.1] * width, 3), (1008, [0.1] * width, 3), (None, [2.0] * width, 0),  # one id, no id
    ]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit("x").alias(name) for name in CLASH])


def floors(vector, scale):
    """Whole numbers of a vector of floats, by exact fractions; None where it is not whole."""
    if vector is None or any(x is None or not np.isfinite(x) for x in vector):
        return None
    return [int(Fraction(float(np.float32(x))) * scale // 1) for x in vector]


def brute_codes(rows, c):
    kept = [(i, label, v) for i, vec, label in rows if (v := floors(vec, c.scale)) is not None]
    width = -(-max((len(v) for _, _, v in kept), default=0) // c.parts)
    kept = [(i, label, v + [0] * (c.parts * width - len(v)), v) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[: c.entries]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(c.parts)]
    books = [[cut(r[2])[p] for r in first] for p in range(c.parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(c.rounds):
        for p in range(c.parts):
            groups = {}
            for r in kept:
                groups.setdefault(nearest(cut(r[2])[p], books[p])[1], []).append(cut(r[2])[p])
            for k, members in groups.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out, totals = [], {}
    for i, label, v, _ in kept:
        found = [nearest(x, book) for x, book in zip(cut(v), books, strict=True)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        totals[label] = totals.get(label, 0) + out[-1][3]
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[2:]
    return sorted((r + (totals[r[1]],) for r in out), key=key), books


@pytest.mark.parametrize("c", [CodeConfig(), CodeConfig(parts=3, entries=5, rounds=3, bits=1), CodeConfig(entries=200, bits=5, rows=7)])
def test_codes_equal_brute_force(spark, c):
    rows = vectors(random.Random(3), 90) + odd_vectors()
    codes, books = vector_codes(frame(spark, rows), c)
    expected, brute = brute_codes(rows, c)
    assert sorted(map(tuple, codes.collect()), key=lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[2:]) == expected
    assert books.tolist() == brute
    assert fingerprint(books) == fingerprint(np.array(brute))
    back = {(r["id"], tuple(r["vec"])) for r in decoded(codes, books, c).collect()}
    for i, _, code, _, _ in expected:
        assert (i, tuple(x / c.scale for p in range(c.parts) for x in brute[p][int(code[2 * p : 2 * p + 2], 16)])) in back


def test_codes_of_few_or_no_vectors(spark):
    codes, books = vector_codes(frame(spark, []))
    assert (codes.collect(), books.size) == ([], 0)
    codes, books = vector_codes(frame(spark, [(1, None, 1)]))
    assert codes.collect() == []
    codes, _ = vector_codes(frame(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (3, [], None)]))
    assert sorted(map(tuple, codes.collect())) == [(1, 1, "00" * 8, 0, 0), (2, 1, "00" * 8, 0, 0), (3, None, "02" * 8, 0, 0)]
    with pytest.raises(ValueError):
        vector_codes(frame(spark, []), CodeConfig(entries=257))
    with pytest.raises(Exception, match="do not fit 64 bits"):
        vector_codes(frame(spark, [(1, [1e30], 1)]))


def test_bounds_leave_the_nearest_entry_and_drop_most_others():
    rng = np.random.default_rng(4)
    entries = rng.integers(-9000, 9000, (64, 8))
    x = entries[rng.integers(0, 64, 500)] + rng.integers(-300, 300, (500, 8))
    best, distance, refined = Cells(entries, 5).nearest(x)
    every = np.square(x[:, None] - entries[None]).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert refined < 0.1 * every.size
    large = Cells(entries * (1 << 14), 5).nearest(x * (1 << 14))  # sums past 2 ** 53 are added up in whole numbers
    assert (large[0] == best).all() and (large[1] == distance * (1 << 28)).all()


def brute_negatives(rows, c, is_anchor):
    kept = [(i, label, v) for i, vec, label in rows if i is not None and label is not None and (v := floors(vec, c.scale)) is not None]
    out = []
    for i, label, v in kept:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, other) for j, other, w in kept if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][: c.positives]:
            inside = [(n, -t) for t, n, other in scored if other != label and -c.low_percent * s <= -100 * t <= -c.high_percent * s]
            out += [(i, j, rank + 1, n, -s, t) for rank, (n, t) in enumerate(inside[: c.negatives])]
    return sorted(out)


@pytest.mark.parametrize("c", [MiningConfig(), MiningConfig(positives=2, negatives=3, block_bytes=1024, tile=7), MiningConfig(scale=3, low_percent=50, high_percent=130, tile=16)])
def test_hard_negatives_equal_brute_force(spark, c):
    rows = vectors(random.Random(6), 120) + odd_vectors() + [(500 + i, [1.0] * 16, i % 2) for i in range(40)]
    found = hard_negatives(frame(spark, rows).repartition(3), F.col("id") % 10 == 0, c)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute_negatives(rows, c, lambda i: i % 10 == 0)
    assert sorted(map(tuple, found.collect())) == expected
    assert len(expected) > 50


def test_hard_negatives_of_empty_tables_and_lone_rows(spark):
    assert hard_negatives(frame(spark, []), F.col("id") % 10 == 0).collect() == []
    assert hard_negatives(frame(spark, [(1, [1.0], 1)]), F.col("id") % 10 == 0).collect() == []
    assert hard_negatives(frame(spark, [(0, [1.0], 1), (1, [1.0], None), (2, [1.0], 2)]), F.col("id") % 10 == 0).collect() == []
    below = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]  # a window below zero is empty
    assert hard_negatives(frame(spark, below), F.col("id") % 10 == 0).collect() == []
    nothing = [(0, [0.0], 1), (1, [5.0], 1), (2, [7.0], 2)]  # and one at zero holds zeros
    assert [tuple(r) for r in hard_negatives(frame(spark, nothing), F.col("id") % 10 == 0).collect()] == [(0, 1, 1, 2, 0, 0)]


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    for top in (1 << 10, 1 << 25, 1 << 29, 1 << 30):
        a, b = rng.integers(-top, top, (5, 6)), rng.integers(-top, top, (4, 8))
        exact = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=False)) for s in b] for r in a]
        assert products(a.astype(float), b.astype(float)).astype(np.int64).tolist() == exact
    with pytest.raises(ValueError):
        products(np.full((1, 4), float(1 << 40)), np.full((1, 4), float(1 << 40)))


def test_best_lists_merge_ties_by_id():
    rng = random.Random(9)
    best, seen = Best(3, 4), {0: [], 1: [], 2: []}
    for _ in range(30):
        ids = np.array(sorted(rng.sample(range(1000), 6)))
        scores = np.array([[rng.randrange(5) for _ in ids] for _ in range(3)])
        hits = np.array([[rng.random() < 0.7 for _ in ids] for _ in range(3)])
        for r in range(3):
            seen[r] += [(-s, i) for s, i, h in zip(scores[r].tolist(), ids.tolist(), hits[r], strict=True) if h]
        best.add(np.arange(3), scores, ids, hits.copy())
    for r in range(3):
        assert list(zip((-best.score[r]).tolist(), best.id[r].tolist(), strict=True)) == sorted(seen[r])[:4]


def test_binary_lengths():
    sizes = np.array([1, 7, 2048, 2049, 5000, 4096])
    doc, length = binary_lengths(sizes, 2048)
    assert [length[doc == k].tolist() for k in range(6)] == [[1], [4, 2, 1], [2048], [2048, 1], [2048, 2048, 512, 256, 128, 8], [2048, 2048]]
    assert binary_lengths(np.array([3]), 1)[1].tolist() == [1, 1, 1]


def brute_pieces(rows, most, end_id=1):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(TokenConfig().path), []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        at = 0
        while at < len(ids):
            n = min(most, 1 << ((len(ids) - at).bit_length() - 1))
            out.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), ids[at : at + n]))
            at += n
    return out


@pytest.mark.parametrize("most", [2048, 8])
def test_packing_equals_brute_force(spark, tmp_path, most):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma!", "x1", "straße", "日本"]) for _ in range(rng.randrange(200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "same"), (103, "same"), (None, "no id"), (104, "word and " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", *[F.lit(1).alias(x) for x in ("start", "length", "task", "place", "ids")])
    c, path = PackConfig(tokens=most), f"file://{tmp_path}/packed"
    write_packed(docs, path, c)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = sorted(brute_pieces(rows, most), key=key)
    found = read_packed(spark, path, c).collect()
    assert sorted(((r["doc_id"], r["start"], r["length"], zlib.crc32(np.array(r["ids"], "<u4").tobytes()), r["doc_tokens"], r["ids"]) for r in found), key=key) == expected
    assert sorted(r["sequence_id"] for r in found) == list(range(len(expected)))
    lengths = [r["length"] for r in sorted(found, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    for rows_broadcast in (100_000, 0):
        digest = packed_digest(spark, path, PackConfig(tokens=most, broadcast_rows=rows_broadcast))
        assert digest.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in digest.collect()), key=key) == [r[:5] for r in expected]
    plan = read_packed(spark, path, c).where("length = 4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "length" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_packing_of_an_empty_table_and_wrong_lengths(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_packed(docs, f"file://{tmp_path}/none")
    assert packed_digest(spark, f"file://{tmp_path}/none").collect() == []
    with pytest.raises(ValueError):
        write_packed(docs, f"file://{tmp_path}/odd", PackConfig(tokens=100))


def test_packing_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = op12_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == sorted(r[:5] for r in brute_pieces(rows, 2048))
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found))) and {r["offset"] for r in found} == {0}
