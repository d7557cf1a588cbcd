"""Merkle manifest, mixing and ranked search against plain Python, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import merkle, mixing, queries, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and rain house river stone light green walk sun moon Ñandú naïve x1 y2 Ωmega don't".split()


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def prose(rng, n):
    return " ".join(rng.choice(WORDS[: 2 + rng.randrange(len(WORDS) - 2)]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null and empty texts, repeated rows, copies, one long text, a hot source, a null source and a null language."""
    rng = random.Random(9)
    texts = [None, "", " \n", "!!", "A", "the THE The", "word " * 30_000] + [prose(rng, rng.randint(1, 200)) for _ in range(120)] + ["Same words here"] * 30
    out = [(i, t, None if i == 3 else "en", None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return out + out[8:10]


@pytest.fixture(scope="module")
def folders(spark, rows, tmp_path_factory):
    """The rows and items, with columns of the operators' own names, and empty tables."""
    rng, out = random.Random(2), {}
    items = [(0, "the rain"), (1, None), (2, "!!"), (3, "rain RAIN stone"), (3, "rain RAIN stone"), (4, prose(rng, 60)), (5, "Ñandú Ωmega nowhere")]
    for name, docs, queried in (("full", rows, items), ("empty", [], []), ("no_items", rows, []), ("no_docs", [], items)):
        folder = tmp_path_factory.mktemp(name)
        clash = {c: F.lit(c) for c in ("_g", "_pos", "_s", "size", "terms", "leaf", "rank", "depth", "a.b")}
        spark.createDataFrame(docs, DOCS).withColumns(clash).repartition(5).write.parquet(f"file://{folder}/documents.parquet")
        spark.createDataFrame(queried, "item_id long, text string").withColumns(clash).write.parquet(f"file://{folder}/benchmark.parquet")
        out[name] = f"file://{folder}"
    return out


@pytest.mark.parametrize("name", ["op11_merkle_upper", "op12_mix_entropy", "op13_ranked_threshold"])
@pytest.mark.parametrize("folder", ["empty", "no_items", "no_docs"])
def test_empty(spark, folders, name, folder):
    if folder == "empty" or (name[:4] == "op13"):
        assert queries.QUERIES[name](spark, folders[folder]).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_upper", "op13_ranked_threshold"])
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, sf)
    assert compare.rows(df.columns, df.collect()) == compare.rows(*compare.oracle(sf, queries.ORACLE_SQL[name]))


def paths_of(nodes):
    """Root, and the siblings of each node level by level, one node at a time."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = range(at[i] // 16 * 16, min(len(nodes), at[i] // 16 * 16 + 16))
            path.append([nodes[j] for j in run if j != at[i]])
            at[i] //= 16
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest_of(leaves):
    """(group, key, leaf) with subroot, root and proof's digest, as a list."""
    groups = defaultdict(list)
    for g, key, leaf in leaves:
        groups[g].append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: paths_of([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = paths_of([trees[g][0] for g in order])
    return root, [(g, k if there else None, leaf, trees[g][0], root, h(*[x for level in path + over for x in level])) for g, over in zip(order, above, strict=True) for (there, k, leaf), path in zip(sorted(groups[g]), trees[g][1], strict=True)]


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def test_manifest(spark, folders, rows):
    leaf = lambda r, text: h(told(r[0]), told(r[3]), told(r[2]), told(r[4]), told(text))
    root, want = manifest_of([(r[3], r[0], leaf(r, r[1])) for r in rows])
    got = queries.op11_merkle_upper(spark, folders["full"]).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == Counter(w[1:] for w in want)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] and r[1].translate(lower) != r[1]}
    assert {r.doc_id for r in got if not r.verified} == changed and changed
    assert all((r.folded_root == root) == r.verified for r in got)


@pytest.mark.parametrize(("sizes", "levels", "top"), [([5000, 1, 17, 300], 3, 4096), ([700, 1, 16, 257] + [2] * 20, 1, 4096), ([700, 1, 17, 16, 300] + [2] * 40, 1, 10), ([1], 3, 4096), ([1] * 40, 1, 2)])
def test_reductions_agree(spark, sizes, levels, top):
    """Several distributed steps within groups and over groups give the tree that one small tree gives."""
    leaves = [(None if g == 1 else f"g{g}", k if k else None, h(str(g), str(k))) for g, n in enumerate(sizes) for k in range(n)]
    _, want = manifest_of(leaves)
    random.Random(1).shuffle(leaves)
    tree = merkle.build(spark.createDataFrame(leaves, "g string, k long, leaf string"), "k", "g", levels=levels, top=top)
    got = tree.rows(paths=True).collect()
    assert Counter((r.group, r.k, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == Counter(want) and all(r.verified for r in got)
    for r in got[:50]:
        node = r.leaf
        for step in r.path:
            node = h(step.l, node, step.r)
        assert node == tree.root
    assert {(r.group, r.n_rows) for r in tree.subroots().collect()} == {(None if g == 1 else f"g{g}", n) for g, n in enumerate(sizes)}


def mixture_of(rows):
    """Targets by filling up, rates by bisection, one source at a time."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(size(r[1]))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total, weight = sum(map(sum, by.values())), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * total
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 2 * sum(by[s])]
        if not over:
            target |= {s: weight[s] * share for s in free}
            break
        for s in over:
            target[s] = 2.0 * sum(by[s])
            left -= target[s]
            free.remove(s)
    rates = {}
    for s in order:
        x = [v for v in by[s] if v]
        if x and target[s] < 2 * sum(x) - 1e-9:
            lo, hi = -1000.0, 1000.0
            for _ in range(300):
                mid = (lo + hi) / 2
                words = sum(v * math.exp(min(mid * v * len(x) / sum(x), math.log(2))) for v in x)
                lo, hi = (mid, hi) if words < target[s] else (lo, mid)
            rates[s] = {v: math.exp(min(lo * v * len(x) / sum(x), math.log(2))) for v in x}
        else:
            rates[s] = dict.fromkeys(x, 2.0)
    return target, rates, by


def test_mixture(spark, folders, rows):
    out = mixing.mix(spark.read.parquet(f"{folders['full']}/documents.parquet")).collect()
    target, rates, by = mixture_of(rows)
    assert sum(target.values()) == pytest.approx(1.5 * sum(map(sum, by.values())))
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[3]) for r in rows)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sum(by[r.source]) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        if r.size:
            assert r.rate == pytest.approx(rates[r.source][r.size], abs=1e-4)
    for s, words in by.items():
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], max(words) / 2 if len(words) < 40 else 3)
    again = queries.op12_mix_entropy(spark, folders["full"]).select("doc_id", "taken").collect()
    assert Counter((r.doc_id, r.taken) for r in out) == Counter((r.doc_id, r.taken) for r in again)


def test_mixture_in_chunks_and_parts(spark):
    """Chunks of few sizes hand what they leave to the lowest one, and a heavy size is dealt over parts: each copy once."""
    rng = random.Random(4)
    rows = [(i, "b" if i % 2 else "a", rng.choice([7, 7, 7, rng.randint(1, 90), rng.randint(1, 900)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, _s string, size long")
    hist = df.groupBy("_s", "size").agg(F.count("*").alias("n"))
    sources = spark.createDataFrame([(s, sum(r[2] for r in rows if r[1] == s), f * sum(r[2] for r in rows if r[1] == s)) for s, f in (("a", 0.4), ("b", 1.6))], "_s string, source_size long, target double")
    tilts = mixing.balanced(hist, sources)
    for r in tilts.collect():
        assert abs(r.words - r.target) <= 0.5
    groups = mixing.dealt(hist, tilts, chunk=16)
    out = mixing.copies(df, groups, len(rows)).collect()
    given = Counter()
    for r in out:
        given[(r._s, r["size"])] += r.copies
    assert given == Counter({(r._s, r["size"]): r.k for r in groups.collect() if r.k})
    for s, f in (("a", 0.4), ("b", 1.6)):
        assert abs(sum(r.copies * r["size"] for r in out if r._s == s) - f * sum(r[2] for r in rows if r[1] == s)) <= 8
    spread = {r.copies for r in out if r["size"] == 7 and r._s == "b"}
    assert len(spread) <= 2 and max(spread) - min(spread) <= 1


def test_targets_over_many_sources(spark):
    rows = [(f"s{i:03}", i * i) for i in range(200)]
    got = {r._s: r.target for r in mixing.targets(spark.createDataFrame(rows, "_s string, source_size long")).collect()}
    assert sum(got.values()) == pytest.approx(1.5 * sum(n for _, n in rows))
    level = max(got[s] / (3, 1, 2)[i % 3] for i, (s, _) in enumerate(rows))
    for i, (s, n) in enumerate(rows):
        assert got[s] == pytest.approx(min(2 * n, (3, 1, 2)[i % 3] * level))


def ranking_of(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pattern.findall((t or "").translate(lower))
    counts = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in dict(items).items():
        found = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score > 0:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("item_bytes", [4_000_000, 1])
def test_ranking(spark, folders, rows, item_bytes):
    docs, items = (spark.read.parquet(f"{folders['full']}/{t}.parquet") for t in ("documents", "benchmark"))
    want = ranking_of([(r[0], r[1]) for r in rows], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert Counter(tuple(r) for r in ranked.search(docs, items, item_bytes=item_bytes).collect()) == want
    assert Counter(tuple(r) for r in queries.op13_ranked_threshold(spark, folders["full"]).collect()) == want


def test_pruning_is_safe_and_prunes(spark):
    """Frequent terms aren't joined where rare ones already give k documents, and ranks stay those of brute force."""
    rng = random.Random(8)
    docs = [(i, " ".join([rng.choice(["the", "of", "and"]) for _ in range(20)] + [rng.choice(WORDS[3:]) for _ in range(5)] + (["seldom"] * rng.randint(1, 3) if i % 20 == 0 else []))) for i in range(1000)]
    items = [(0, "the of and seldom"), (1, "the of"), (2, "seldom rain the")]
    index = ranked.index_of(items)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    stored = ranked.written(ranked.postings(df, index))
    n, total = 1000, sum(len(ranked.terms(t)) for _, t in docs)
    freq = Counter(t for _, text in docs for t in set(ranked.terms(text)))
    w = ranked.weights(n, np.array([freq[t] for t in index.names]))
    top = defaultdict(list)
    for r in ranked.top_impacts(stored, w, n, total).orderBy("at").collect():
        top[r.term].append(r.impact)
    largest, kth = (np.array([top[t][i] if len(top[t]) == 10 else 0 for t in range(len(w))]) for i in (0, -1))
    thresholds, essential = ranked.prune(index, largest, kth)
    names = list(index.names)
    joined = [{names[index.term[j]] for j in range(index.starts[i], index.starts[i + 1]) if essential[j]} for i in range(3)]
    assert joined[0] == {b"seldom"} and thresholds[0] > 0
    want = ranking_of(docs, items)
    assert Counter(tuple(r) for r in ranked.search(df, spark.createDataFrame(items, "item_id long, text string")).collect()) == want
    for item, rank, _, score in want:
        assert rank > 10 or score >= thresholds[item]


def test_dealing_goes_by_cost():
    """Each piece goes to the cheapest sequence with room for it, found by trying all of them; else the roomiest takes a part."""
    from lumenframe.llm import packing

    rng = random.Random(6)
    for size, n in ((50, 40), (50, 1), (7, 60), (2048, 120)):
        lengths = [rng.choice([1, 2, rng.randint(1, size - 1), rng.randint(1, size - 1)]) for _ in range(n)]
        room, load = [size] * -(-sum(lengths) // size), [0.0] * -(-sum(lengths) // size)
        want = [[] for _ in lengths]
        for k in sorted(range(n), key=lambda k: -lengths[k]):  # of equal lengths the earlier first
            start = 0
            while start < lengths[k]:
                left = lengths[k] - start
                able = [s for s in range(len(room)) if room[s] >= left]
                at = min(able, key=lambda s: (load[s], s)) if able else min(range(len(room)), key=lambda s: (-room[s], s))
                take = min(left, room[at])
                want[k].append((start, take, at, size - room[at]))
                room[at] -= take
                load[at] += packing.LINEAR * take + packing.QUADRATIC * take * take
                start += take
        assert packing.deal(lengths, size) == want


def spark_hash(*parts):
    """Spark's xxhash64 of ints, longs and strings: XXH64, each part seeded by the hash of those before."""
    import struct

    import xxhash

    seed = 42
    for kind, x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", x), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_imatch_equals_brute_force(spark, tmp_path):
    from lumenframe.llm import imatch

    rng = random.Random(12)
    texts = [None, "", "!!", "ÉTUDE x_y"] + [" ".join(rng.choice(["the", f"w{rng.randrange(70)}", f"É{rng.randrange(30)}", f"Σx-{rng.randrange(30)}"]) for _ in range(rng.randint(1, 60))) for _ in range(90)]
    rows = [(i, t) for i, t in enumerate(texts + texts[10:14])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")

    split = lambda t: list(dict.fromkeys(x for x in re.split(r"[^\w]|_", (t or "").lower()) if x))
    df = Counter(t for r in rows for t in split(r[1]))
    low, high = max(2, len(rows) * imatch.LOW), max(2, len(rows) * imatch.HIGH)
    lexicon = {t: spark_hash(("s", t)) for t, n in df.items() if low <= n <= high}
    assert len(lexicon) > 5
    subsets = [{t for t in lexicon if spark_hash(("i", k), ("s", t)) % imatch.KEEP[k // imatch.EACH] == 0} for k in range(imatch.SUBSETS)]
    masks = {t: sum(1 << k for k in range(imatch.SUBSETS) if t in subsets[k]) for t in lexicon}

    def parts(text):
        mine = sorted((lexicon[t], masks[t], t) for t in split(text) if t in lexicon and masks[t])
        return [f"{spark_hash(*[('l', h) for h, _, t in mine if t in s]) % (1 << 64):016x}"[:8] if any(t in s for _, _, t in mine) else imatch.NONE for s in subsets]

    def like(a, b):
        there = [(x, y) for x, y in zip(a, b, strict=True) if x != imatch.NONE or y != imatch.NONE]
        return sum(x == y for x, y in there) / len(there) if there else 1.0

    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    want = Counter()
    for one, after in zip(order, order[1:] + order[:1], strict=True):
        text, n = one[1] or "", len(one[1] or "")
        own, edited, other = parts(text), parts(text[: n - n // 2] + (after[1] or "")[: n // 2]), parts(after[1])
        want[one[0], "".join(own), "".join(edited), round(like(own, edited), 9), round(like(own, other), 9)] += 1
    got = queries.op7_imatch(spark, f"file://{tmp_path}").collect()
    assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert any(r.near_edited > 0 for r in got if r.n_chars > 0)


@pytest.mark.parametrize(("kind", "most"), [("string", 20_000), ("long", 20_000), ("long", 2), ("decimal(20,0)", 20_000), ("decimal(20,0)", 0)])
def test_imatch_takes_ids_of_any_type(spark, monkeypatch, kind, most):
    """Chunks by quantile and by rank give the same next documents."""
    from lumenframe.llm import imatch

    monkeypatch.setattr(imatch, "CHUNK_ROWS", 3)
    monkeypatch.setattr(imatch, "MAX_CHUNKS", most)
    rows = [(i, f"text {i}") for i in range(20)] + [(None, "none"), (7, "again"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = imatch.fingerprints(df, low=0.0, high=1.0).collect()
    order = sorted(rows, key=lambda r: r[1] or "")
    order = sorted(order, key=lambda r: str(r[0]) if kind == "string" else r[0] or 0, reverse=True)
    order = sorted((r for r in order if r[0] is not None), key=lambda r: str(r[0]) if kind == "string" else r[0], reverse=True) + [r for r in order if r[0] is None]
    want = Counter()
    for one, after in zip(order, order[1:] + order[:1], strict=True):
        t = one[1] or ""
        want[None if one[0] is None else str(one[0]), t[: len(t) - len(t) // 2] + (after[1] or "")[: len(t) // 2]] += 1
    told = Counter((None if r.doc_id is None else str(r.doc_id), r.edited_sha256) for r in got)
    assert told == Counter({(i, sha256(t.encode()).hexdigest()): n for (i, t), n in want.items()})
    assert imatch.fingerprints(df.limit(0)).count() == 0
