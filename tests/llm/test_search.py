import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from viewfield.llm import contain, jaccard, lineruns, queries, suffixes
from viewfield.llm.components import components, joined

from .helpers import awkward, frame, words


def grams(text):
    w = (text or "").encode().translate(jaccard.LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """Brute force: smallest id by links of similarity 0.8."""
    sets = {}
    for d, t in rows:
        if d is not None and (d not in sets or len(grams(t)) > len(sets[d])):
            sets[d] = grams(t)
    at = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and at[a] != at[b]:
                    at[a] = at[b] = min(at[a], at[b])
                    changed = True
    return {d: (len(s), at[d]) for d, s in sets.items()}


def chain():
    """Near copies each a little further on, so that the ends are linked through the middle only; and a hot group."""
    base, rows = words(7, 200), []
    for i in range(12):
        rows.append((100 + i, " ".join(base)))
        base = base[: 8 * i] + ["new%d" % i] + base[8 * i + 1 :]
    common = " ".join(words(8, 14))
    rows += [(200 + i, " ".join([common, *words(50 + i, 3 + i % 9)])) for i in range(60)]
    rows += [(300 + i, " ".join(words(9, 60)) + f" end{i % 4}") for i in range(60)]
    return rows


@pytest.mark.parametrize("rows", [[r[:2] for r in awkward()], chain()])
def test_jaccard_join(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, spare string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == groups(rows)


def linked_with(rows):
    """Brute force: the number of other documents of similarity 0.8."""
    sets = {d: grams(t) for d, t in rows if d is not None}
    return {a: sum(a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and bool(sets[a]) for b in sets) for a in sets}


@pytest.mark.parametrize("rows", [[r[:2] for r in awkward()], chain(), [(i, " ".join([*words(60, 100), f"end{i % 40}"])) for i in range(70)]])
def test_jaccard_counts_all_links(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.n_links for r in jaccard.join(df).collect()} == linked_with(rows)


def test_links_beside_an_unlinked_centre(spark):
    """Two linked sets, and one that shares entries with both but links with neither and comes first by id and by hash."""
    r = words(70, 100)
    texts = [" ".join([*r[:89], *words(71, 11)]), " ".join([*r[:99], "x"]), " ".join([*r[:99], "y"])]
    order = [x.id for x in spark.range(1, 50).selectExpr("id", "xxhash64(1, id) AS o").orderBy("o").collect()]
    first = min(order[:5])
    ids = [first, *[i for i in order[order.index(first) + 1 :] if i > first][:2]]
    assert len(ids) == 3
    got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.join(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert got == {ids[0]: (ids[0], 0), ids[1]: (min(ids[1:]), 1), ids[2]: (min(ids[1:]), 1)}


def templates():
    """Sets that share most of their n-grams with many that they do not link with, in several ways, and some links among them."""
    common, rows = words(80, 120), []
    for i in range(40):  # three quarters in common: similar to 0.6
        rows.append((i, " ".join([*common, *words(1000 + i, 44)])))
    for i in range(40):  # near copies of some of these
        rows.append((100 + i, " ".join([*common, *words(1000 + i % 8, 44)[: 40 + i % 4], f"t{i}"])))
    for i in range(30):  # nine tenths in common, but of different parts
        rows.append((200 + i, " ".join([*common[: 60 + 2 * i], *words(81, 10)])))
    return rows


@pytest.mark.parametrize("hot,block", [(20, 512), (3, 7), (1, 3)])
@pytest.mark.parametrize("make", [chain, templates])
def test_jaccard_with_hot_lists(spark, monkeypatch, make, hot, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(df).collect()}
    links = linked_with(rows)
    assert got == {d: (*x, links[d]) for d, x in groups(rows).items()}


@pytest.mark.parametrize("parts", [1, 4])
def test_jaccard_of_repeated_ids_with_different_texts(spark, parts):
    a, b = " ".join(words(75, 60)), " ".join(words(76, 40))
    rows = [(1, a), (1, b), (2, b), (3, b + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(df).collect()} == {1: (1, 0), 2: (2, 1), 3: (2, 1)}
    alone = jaccard.join(df, links=False)
    assert alone.columns == ["doc_id", "n_shingles", "component_id"] and {r.doc_id: r.component_id for r in alone.collect()} == {1: 1, 2: 2, 3: 2}


def test_hot_lists_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "GATHERED", 50)
    r = np.random.default_rng(5)
    whole = [(s, np.sort(r.choice(12, 6, replace=False)).astype(np.uint32), np.arange(6, dtype=np.int64) + 6 * i) for i, s in enumerate(r.integers(0, 3, 200))]
    batches = [pa.table({"shard": pa.array([s], pa.int32()), "entries": [e.tobytes()], "owners": [jaccard._pack(o, int(o.min()))]}).to_batches()[0] for s, e, o in whole]
    want = {}
    for s, e, o in whole:
        for x, y in zip(e, o):
            want.setdefault((int(s), int(x)), set()).add(int(y))
    got = {}
    for batch in jaccard._buckets(batches):
        for b, d, n in zip(*(c.to_pylist() for c in batch.columns)):
            got.setdefault(b, []).append(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_shared_entries_are_all_counted(spark):
    """Two sets and a copy share entries in several tasks, which is one bucket: each of them counts."""
    base = words(77, 300)
    texts = [" ".join(base), " ".join([*base[:150], "x", *base[151:]]), " ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = jaccard.stored(jaccard._index(docs, 8), "index")
    copies = spark.createDataFrame([(2, 0)], "doc_id long, first long")
    got = jaccard._members(index, copies, 8).groupBy("doc_id").agg({"entries": "sum"}).collect()
    grams_of = jaccard.Grams()
    keys = [{(int(e >> np.uint64(32)) % 8, int(e) & 0xFFFFFFFF) for e in jaccard.entries(grams_of(t))[0]} for t in texts]
    sums = {r.doc_id: r["sum(entries)"] for r in got}
    assert sums[1] == len(keys[0] & keys[1]) > 20 and sums[0] == len(keys[0]) and set(sums) == {0, 1}


@pytest.mark.parametrize("split", [0, 9])
def test_shared_counts(split):
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 40 if i % 2 else 5000, r.integers(1, 60))).astype(np.uint64) for i in range(25)]
    rows, columns = (sets[:split], sets[split:]) if split else (sets, sets)
    got = jaccard.shared(sets, split or len(sets))
    want = np.array([[len(np.intersect1d(a, b)) for b in columns] for a in rows])
    if not split:
        np.fill_diagonal(got, 0)
        np.fill_diagonal(want, 0)
    assert (got == want).all()


def test_jaccard_of_nothing(spark):
    assert jaccard.join(frame(spark, [])).count() == 0


def test_entries_meet():
    r = np.random.default_rng(3)
    for size in [*range(1, 40), 90, 300, 700]:
        for _ in range(10):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) * 2)
            gone = r.integers(0, size // 5 + 1)
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, r.integers(0, size // 8 + 1), dtype=np.uint64)]))
            if len(b) and jaccard.linked(a, b):
                (x, least), (y, _) = jaccard.entries(a), jaccard.entries(b)
                assert len(np.intersect1d(x, y)) >= max(1, least)
                assert jaccard.at_least_apart(jaccard.sketch(a), jaccard.sketch(b)) <= jaccard.differ(len(a), len(b))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (70, 70)] + [(80, x) for x in range(81, 120)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50, **{i: 80 for i in range(80, 120)}}


def test_components_joined(spark):
    links = [(1, 2), (2, 3), (10, 11), (20, 21), (22, 21), (30, 31)]
    more = [(3, 11), (21, 40), (41, 40), (50, 51), (31, 30)]
    pairs = lambda x: spark.createDataFrame(x, "a long, b long")
    got = joined(components(pairs(links)), pairs(more)).collect()
    assert dict(got) == dict(components(pairs(links + more)).collect()) and len(got) == len(dict(got))
    assert dict(joined(components(pairs(links)), pairs([])).collect()) == dict(components(pairs(links)).collect())


def removed(texts, window=200):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((len(d), bytes(c for c, g in zip(d, gone) if not g), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out


def test_suffix_dedup(spark):
    long = " ".join(words(20, 400))
    extra = [(500 + i, long[i * 7 : i * 7 + 230 + i * 40]) for i in range(12)] + [(600, "ab" * 700), (601, "x" * 199), (602, "x" * 199), (603, "y" * 200), (604, "y" * 200)]
    rows = [r[:2] for r in awkward()] + extra
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, a long, seed string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept), r.n_spans, r.n_removed) for r in suffixes.dedup(df).collect())
    assert got == sorted((-1 if d is None else d, n, kept, spans, n - len(kept)) for (d, _), (n, kept, spans) in zip(rows, removed([t for _, t in rows])))


def test_suffix_dedup_of_hot_seeds(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    passage = " ".join(words(21, 60))
    rows = [(i, " ".join(words(900 + i, 30)) + " " + passage + " " + " ".join(words(950 + i, 30))) for i in range(9)]
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept), r.n_spans) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d, n, kept, spans) for (d, _), (n, kept, spans) in zip(rows, removed([t for _, t in rows])))


def passages(n):
    passage = " ".join(words(22, 60))
    return [(i, " ".join(words(1900 + i, 30)) + " " + passage + " " + " ".join(words(2950 + i, 30))) for i in range(n)]


def test_hot_seeds_are_not_gathered(spark, monkeypatch):
    """Of a passage in many documents, no task gets the bytes: hot windows are dealt by their hashes."""
    monkeypatch.setattr(suffixes, "HOT", 20)
    rows, seen = passages(60), []
    cut = suffixes._cut

    def counted(listed, shards):
        out = cut(listed, shards)
        seen.extend(r["count"] for r in out.groupBy("seed").count().collect() if r.seed is not None)
        seen.append(-out.where("seed is null").count())
        return out

    monkeypatch.setattr(suffixes, "_cut", counted)
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept), r.n_spans) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d, n, kept, spans) for (d, _), (n, kept, spans) in zip(rows, removed([t for _, t in rows])))
    assert max(seen) <= 20 and min(seen) < 0


def spans_of(runs):
    got = {}
    for r in runs.collect():
        got.setdefault(r.doc_id, set()).update(range(r.a, r.a + r.n))
    return got


def test_family_of_many_batches():
    r = np.random.default_rng(9)
    family, whole, found = suffixes.Family(), [], []
    for k in range(40):
        rows = np.zeros(50, suffixes.SUFFIX)
        rows["seed"], rows["chunk"], rows["doc"], rows["a"] = r.integers(0, 300, 50), r.integers(0, 6, 50), k, np.arange(50)
        whole.append(rows.copy())
        found.append(family.add(rows))
        sizes = [order for order, *_ in family.levels]
        assert sizes == sorted(set(sizes), reverse=True) and len(sizes) <= 6  # a logarithm of the batches
    whole, found = np.concatenate(whole), np.concatenate(found)
    kinds = [(s, c) for s, c in zip(whole["seed"].tolist(), whole["chunk"].tolist())]
    want = {(int(d), int(a)) for d, a, k in zip(whole["doc"], whole["a"], kinds) if kinds.count(k) > 1}
    got = [(int(d), int(a)) for d, a in zip(found["doc"], found["a"])]
    assert len(got) == len(set(got)) and set(got) == want
    rows, counts = family.shared()
    several = {s for s, _ in kinds if len({k for k in kinds if k[0] == s}) > 1}
    assert {s for s in several if any(kinds.count(k) == 1 for k in kinds if k[0] == s)} == set(rows["seed"].tolist()) and all(counts > 1)


def test_levels_opened_again(spark):
    """Documents that come later find what the kept levels hold, as if all had come at once."""
    rows = passages(20) + [(100 + i, t) for i, t in passages(3)] + [(200, "no repeat of any kind " * 3)]
    df = suffixes.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    old, new = df.where("id < 8"), df.where("id >= 8")
    first, levels = suffixes.repeats(old, keep=True)
    assert levels.count() > 0
    later, more = suffixes.repeats(new, levels, old, keep=True)
    assert spans_of(first.union(later)) == spans_of(suffixes.repeats(df)[0])
    assert more.where("level > 0").count() > 0


def test_texts_of_one_short_hash_and_no_id(spark):
    """Rows without an id whose texts share 32 bits of hash are documents of their own."""
    passage = " ".join(words(77, 80))
    made = spark.range(400_000).selectExpr(f"concat(id, ' ', substring('{passage}', 1 + CAST(id % 7 AS INT), 250 + CAST(id % 50 AS INT))) AS text")
    pairs = [r.texts for r in made.groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").limit(3).collect()]
    assert len(pairs) == 3
    rows = [(None, t) for texts in pairs for t in sorted(texts)[:2]] + [(-(1 << 63), pairs[0][0][:240]), (None, None)]
    got = sorted((str(r.doc_id), r.n_bytes, bytes(r.kept), r.n_spans) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((str(d), n, kept, spans) for (d, _), (n, kept, spans) in zip(rows, removed([t for _, t in rows])))


def test_packs_are_gathered_before_they_are_scanned(monkeypatch):
    import pyarrow as pa

    calls, add = [], suffixes.Family.add
    monkeypatch.setattr(suffixes.Family, "add", lambda self, rows: calls.append(len(rows)) or add(self, rows))
    r, packs = np.random.default_rng(4), []
    for _ in range(300):
        rows = np.zeros(1000, suffixes.SUFFIX)
        rows["seed"], rows["chunk"], rows["n"] = r.integers(0, 1 << 40, 1000), r.integers(0, 9, 1000), 1
        packs.append((0, None, None, None, None, None, rows.tobytes()))
    list(suffixes._again([suffixes._batch(packs[i : i + 50], suffixes.CUT) for i in range(0, 300, 50)]))
    assert sum(calls) == 300_000 and len(calls) <= 300_000 // suffixes.GATHERED + 1


def test_long_documents_in_pieces(spark, monkeypatch):
    long = " ".join(words(23, 900))
    rows = [(1, long), (2, long[1000:4000]), (3, "z" * 50 + long[2000:2300]), (4, long[:199])]
    whole = suffixes.chunks(np.frombuffer(long.encode(), np.uint8), np.array([len(long)]))
    monkeypatch.setattr(suffixes, "PIECE", 700)
    pieces = [p for several in suffixes._pieces([long]) for p in several]
    assert len(pieces) > 5 and sum(len(d) - 199 for _, _, d in pieces) == whole["n"].sum() == len(long) - 199
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept), r.n_spans) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d, n, kept, spans) for (d, _), (n, kept, spans) in zip(rows, removed([t for _, t in rows])))


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.dedup(frame(spark, [])).count() == 0


def without_runs(rows, least=200):
    """Brute force over (id, text): later copies of all runs of so many characters."""
    lines = [[] if t is None else [(i, x) for i, x in enumerate(t.split("\n")) if x.strip()] for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for k in sorted(range(len(rows)), key=lambda k: (-1 if rows[k][0] is None else rows[k][0])):
        for a in range(len(lines[k])):
            chars, run = 0, ()
            for i, x in lines[k][a:]:
                chars, run = chars + len(x), hash((run, x))
                if chars >= least:
                    if run in seen:
                        gone[k] |= {j for j, _ in lines[k][a:] if j <= i}
                    seen.add(run)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for (_, t), g in zip(rows, gone)]


def test_line_dedup(spark):
    rows = [r[:2] for r in awkward()[:20]] + [(700 + i, "\n".join(words(30, 45)[i % 3 :] + [f"own{i}"])) for i in range(7)] + [(800, "a\nb\na\nb\na\nb\n\nb")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, n_lines long, line long").repartition(3)
    got = {r.doc_id: r.text for r in lineruns.dedup(df).collect()}
    assert got == dict(zip([d for d, _ in rows], without_runs(rows)))


@pytest.mark.parametrize("least", [1, 7, 40])
def test_line_dedup_against_every_run(spark, least):
    """Lines of 1 to 12 characters drawn from few, so runs of all lengths come again, overlap and touch, within documents too."""
    r = random.Random(least)
    pool = [c * r.randrange(1, 13) for c in "abcdefg"]
    rows = [(i, "\n".join(r.choice(pool + [" ", f"own{i}"]) for _ in range(r.randrange(0, 60)))) for i in range(25)]
    rows += [(50 + i, "\n".join(rows[i][1].split("\n")[3:40] + ["end"])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.text for x in lineruns.dedup(df, least).collect()} == dict(zip([d for d, _ in rows], without_runs(rows, least)))


def test_runs_of_many_short_lines(spark):
    """Only ranks of many lines tell such runs: two of their lines alone, or all but a few, may come again."""
    run = words(50, 60)
    chars = [sum(map(len, run[:n])) for n in range(61)]
    n = next(n for n in range(61) if chars[n] >= 200)
    rows = [(1, "\n".join(run)), (2, "\n".join(run)), (3, "\n".join(run[: n - 1])), (4, "\n".join(["x", *run[:n], "y"])), (5, "\n".join([*run[:9], "z", *run[10:]])), (6, "\n".join(run[4:6]))]
    got = {tuple(r) for r in lineruns.runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert n > 16 and got == {(2, 0, 60), (4, 1, n), (5, 10, 50)}


def test_line_dedup_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = sorted(map(tuple, queries.op8_line_dedup(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(con.sql(lineruns.SQL).fetchall()) and any(r[2] for r in got)


def test_line_dedup_of_repeated_rows_and_of_nothing(spark):
    assert lineruns.dedup(frame(spark, [])).count() == 0
    assert lineruns.dedup(frame(spark)).count() == len(awkward())
    pair = [(1, "a b\nc d", *[None] * 6), (2, "a b\nc d\ne", *[None] * 6)]
    assert lineruns.runs(frame(spark, pair), 6).collect() == [(2, 0, 2)] and lineruns.runs(frame(spark, pair)).count() == 0


def test_containment(spark):
    items = [(1, " ".join(words(40, 30))), (2, "tiny item"), (3, None), (4, ""), (5, " ".join(words(41, 300))), (1, " ".join(words(40, 30)))]
    part = words(41, 300)
    docs = [(1, " ".join([*words(42, 5000), *words(40, 30), *words(43, 10)])), (2, "Tiny  ITEM"), (3, None), (4, ""), (5, " ".join(part[:250])), (6, " ".join(part[:235])), (7, " ".join(words(44, 50))), (None, " ".join(words(40, 30)))]
    docs, items = docs + [docs[0]], items
    want = set()
    for d, t in docs:
        for i, x in items:
            if grams(x) and 100 * len(grams(x) & grams(t)) >= 80 * len(grams(x)):
                want.add((d, i, len(grams(x)), len(grams(x) & grams(t))))
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, h long")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, q long")
    found = {tuple(r) for r in contain.find(df, bench).collect()}
    assert {x for x in found if x[0] is not None} == {x for x in want if x[0] is not None}
    assert {r.doc_id for r in contain.decontaminate(df, bench).collect()} == {3, 4, 6, 7}
    assert contain.find(df.limit(0), bench).count() == 0 and contain.find(df, bench.limit(0)).count() == 0


def test_containment_of_repeated_items(spark):
    """Rows of one item are one item: half of one text and half of the other are not enough of both."""
    x, y = words(45, 30), words(46, 30)
    items = spark.createDataFrame([(1, " ".join(x)), (1, " ".join(y)), (None, " ".join(words(47, 20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([*x[:18], *y[:18]])), (2, " ".join([*x, *y])), (3, " ".join(words(47, 20))), (None, " ".join([*y, *x])), (None, "clean")], "doc_id long, text string")
    assert {tuple(r) for r in contain.find(docs, items).collect()} == {(2, 1, 52, 52)}
    assert sorted(r.text for r in contain.decontaminate(docs, items).collect()) == sorted(r.text for r in docs.collect() if r.doc_id in (1, 3) or r.text == "clean")
