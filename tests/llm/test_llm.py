"""Training-data operators against brute force, exact round trips and edge cases."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import bpe, chat, html, imatch, langid, linededup, nearsets, packing, quality, queries, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", "   \n\t ", "one", "two words", "Hello  World\n\nhello world ß é 😀 <|endoftext|> it's", "a b c a b c a b c d", "x\n x\nx\n\ny\r\ny\r", "#*$%&|<> | |", "word " * 3000, "z" * 5000]


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "rain", "house", "river", "stone", "light", "green", "walk"]) + rng.choice(["", "", "s", "ing", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = TEXTS + [prose(rng, rng.randint(5, 300)) for _ in range(60)]
    texts += texts[5:9] + [texts[20]] * 5
    rows = [(i if i != 3 else None, t, None if i == 4 else "en", None if i == 6 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[12:14], DOCS)


@pytest.fixture(scope="module")
def tables(docs, tmp_path_factory):
    """The fixture and an empty table, as folders with documents, with an extra column."""
    out = {}
    for name, df in (("full", docs.withColumns({"fp": F.lit("clash"), "shard": F.lit("clash")})), ("empty", docs.limit(0))):
        folder = tmp_path_factory.mktemp(name)
        df.write.parquet(f"file://{folder}/documents.parquet")
        df.select(F.col("doc_id").alias("item_id"), "text").limit(0 if name == "empty" else 5).write.parquet(f"file://{folder}/benchmark.parquet")
        out[name] = f"file://{folder}"
    return out


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op5_style_tree", "op8_chat_grammar")])
def test_empty_tables(spark, tables, name):
    assert queries.QUERIES[name](spark, tables["empty"]).count() == 0


def test_quality_base(spark, tables, docs):
    got = Counter(tuple(r) for r in queries.op1_quality_mcd(spark, tables["full"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in docs.collect():
        w, t = words(r.text), r.text or ""
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[(r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert got == want


def test_mcd_rejects_planted_outliers_alone(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        n = int(rng.integers(100, 400))
        odd = i % 20 == 0
        rows.append((i, "en", f"s{i % 2}", n, int(n * rng.normal(5, 0.1)), n if odd else 0, 20, int(rng.integers(0, 2)), int(n * rng.uniform(0, 0.05))))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    gone = {r.doc_id for r in quality.with_verdict(stats).where("NOT kept").collect()}
    assert gone == set(range(0, 600, 20))
    assert {r.doc_id for r in quality.with_verdict(stats.repartition(7)).where("NOT kept").collect()} == gone


def test_mcd_moments_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-3000, 9000, (500, 4))
    df = spark.createDataFrame([("g", 0, *map(int, r)) for r in x], "_g string, _s int, _f0 long, _f1 long, _f2 long, _f3 long")
    row = quality._moments(df, 1.0).first()
    cov = np.cov((x / quality.SCALE).T, bias=True) + np.diag(np.square(quality.FLOOR))
    full = np.zeros((4, 4))
    for (r, c), v in zip(quality.PAIRS, row["_i"], strict=True):
        full[r, c] = full[c, r] = v
    assert np.allclose(full @ cov, np.eye(4), atol=1e-6) and np.allclose(row["_m"], x.mean(0) / quality.SCALE) and np.isclose(row["_d"], np.linalg.slogdet(cov)[1])


def test_mcd_finds_the_smaller_determinant(spark):
    """A third of the rows far off in one place: the kept core has a determinant no larger than any other start's."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.5, (500, 4)), rng.normal(6, 0.1, (160, 4))]) * quality.SCALE
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "_g string, _f0 long, _f1 long, _f2 long, _f3 long")
    start = lambda m, s: quality.checkpoint_groups(spark.createDataFrame([("g", s, m, [1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], float("inf"))], "_g string, _s int, _m array<double>, _i array<double>, _d double"))
    near, far = start([0.0] * 4, 0), start([6.0] * 4, 1)
    both = near.unionByName(far)
    for _ in range(4):
        before = {r._s: r._d for r in both.collect()}
        both = quality._concentrated(df, both)
        assert all(r._d <= before[r._s] + 0.05 for r in both.collect())
    got = {r._s: r._d for r in both.collect()}
    core = x[np.argsort((x**2).sum(1))[: int(0.75 * len(x))]] / quality.SCALE
    assert abs(got[0] - np.linalg.slogdet(np.cov(core.T, bias=True) * quality.CONSISTENT + np.diag(np.square(quality.FLOOR)))[1]) < 0.2
    assert got[0] <= got[1] + 1e-9


def test_each_statistic_can_reject_alone():
    for top, floor in zip((None, None, np.log(6), np.arcsin(np.sqrt(0.5))), quality.FLOOR, strict=True):
        assert top is None or (top / floor) ** 2 > quality.CUTOFF


def test_internal_names_do_not_clash(spark):
    """Input columns of the helpers' own names, and names with dots, come through unchanged."""
    rng = random.Random(1)
    names = ["_lang", "_source", "_f0", "_w", "_l", "_host", "_stay", "_new", "_lines", "_low", "_row", "_text", "_g", "_any", "a.b"]
    rows = [(i, "same line\n" + prose(rng, 80), "en", f"s{i % 2}", f"https://h{i % 2}.example/", f"<p>page {i}</p>", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "url", "html", *names])
    ids = {r[0]: r[6:] for r in rows}
    for out in (quality.with_verdict(quality.with_text_stats(df)), linededup.drop_boilerplate(df), html.extract(df), langid.predict(df, langid.train(df)), bpe.BpeOperator(spark, queries.WORD_VOCABULARY).round_trip(df)):
        got = out.collect()
        assert {r.doc_id: tuple(r[n] for n in names) for r in got} == ids and len(got) == 12


def test_salted_joins_equal_broadcast_ones(spark, docs, monkeypatch):
    from lumenframe.llm import _shared

    before = Counter(map(tuple, linededup.drop_boilerplate(docs, min_pages=2).collect()))
    stats = _shared.written(quality.with_text_stats(docs).drop("text"))
    verdicts = Counter(map(tuple, quality.with_verdict(stats).collect()))
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, linededup.drop_boilerplate(docs, min_pages=2).collect())) == before
    assert Counter(map(tuple, quality.with_verdict(stats).collect())) == verdicts


def test_lexicon_without_broadcast(spark, docs, monkeypatch):
    rows = lambda: Counter((r.doc_id, r.n_chars, tuple(r.parts), tuple(r.edited_parts), tuple(r.next_parts)) for r in imatch.fingerprints(docs.select("doc_id", "text"), low=0.01, high=0.9).collect())
    before = rows()
    monkeypatch.setattr(imatch, "LEXICON_ROWS", -1)
    assert rows() == before


def test_shared_folder_is_asked_for_off_local_masters():
    from types import SimpleNamespace

    from lumenframe.llm._shared import shared_dir

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://a:7077"):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master=master)))


def test_bpe_equals_tokenizers(spark, docs):
    lib = Tokenizer.from_file(queries.WORD_VOCABULARY)
    op = bpe.BpeOperator(spark, queries.WORD_VOCABULARY)
    for r in op.round_trip(docs).collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    both = op.decode(op.encode(docs.select("doc_id", "text", F.lit(1).alias("decoded")))).collect()
    assert all(r.decoded == lib.decode(r.token_ids, skip_special_tokens=False) for r in both)


def test_bpe_random_words_equal_merges_by_rank():
    codec = bpe.Codec(open(queries.WORD_VOCABULARY, encoding="utf-8").read())
    lib = Tokenizer.from_file(queries.WORD_VOCABULARY)
    rng = random.Random(9)
    for _ in range(1500):
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzaeiouth'1.,é ") for _ in range(rng.randint(1, 60)))
        assert list(codec.encode(t)) == lib.encode(t, add_special_tokens=False).ids


def test_shards(spark, tables, docs):
    got = queries.op3_shard_slots(spark, tables["full"]).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= s < 40 for s in by)


def test_shard_map_versions(spark, tmp_path):
    rng = random.Random(2)
    size = {i: rng.randint(0, 10_000) for i in range(64)}
    sizes = spark.createDataFrame(list(size.items()), "vslot int, bytes long")
    loads, want = [0] * 5, {}
    for v in sorted(size, key=lambda v: (-size[v], v)):
        s = v % 5 if (loads[v % 5] + size[v]) * 5 <= sum(size.values()) else loads.index(min(loads))
        want[v], loads[s] = s, loads[s] + size[v]
    folder = f"file://{tmp_path}/map"
    sharding.write_map(sharding.first_map(spark, 5, 64), folder)
    sharding.write_map(sharding.rebalanced(sharding.read_map(spark, folder), sizes, 5), folder)
    second = sharding.read_map(spark, folder)
    assert {r.vslot: r.shard for r in second.collect()} == want and second.first().version == 2
    assert max(loads) - min(loads) < 0.1 * sum(loads) / 5 and sum(want[v] == v % 5 for v in want) > 40
    grown = sharding.grow_map(second, sizes, 5)
    moved = {r.vslot: r.shard for r in grown.collect()}
    assert all(moved[v] in (want[v], 5) for v in want) and 0 < sum(size[v] for v in moved if moved[v] == 5) <= sum(size.values()) / 6
    sharding.write_map(grown, folder)
    assert {r.vslot: r.shard for r in sharding.read_map(spark, folder).collect()} == moved
    assert {r.vslot: r.shard for r in sharding.read_map(spark, folder, 1).collect()} == {v: v % 5 for v in range(64)}


def test_shards_follow_a_stored_map(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/map"
    sharding.write_map(sharding.first_map(spark, 4, 32), folder)
    got = sharding.shard_records(docs.select("doc_id", "text"), 4, 32, folder).collect()
    stored = {r.vslot: r.shard for r in sharding.read_map(spark, folder).collect()}
    assert sharding.read_map(spark, folder).first().version == 2 and len(got) == docs.count()
    from hashlib import md5

    for r in got:
        v = int(md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:8], 16) % 32
        assert (r.vslot, r.shard) == (v, stored[v])


def test_packing(spark, docs):
    lib = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    pieces = packing.pack(docs.repartition(3), open(queries.BYTE_VOCABULARY, encoding="utf-8").read()).collect()
    want = Counter((r.doc_id, tuple([*lib.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    assert sum(r.length for r in pieces) == sum(len(k[1]) * n for k, n in want.items())
    seqs: dict = {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length and 0 < r.length
        options = [ids for (d, ids) in want if d == r.doc_id and len(ids) == r.doc_tokens]
        assert any(list(np.frombuffer(r.ids, "<u4")) == list(ids[r.start : r.start + r.length]) for ids in options)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(seqs) <= sum(r.length for r in pieces) / 2048 + 3


def test_dealing_balances_cost():
    lengths = [random.Random(1).randint(1, 2047) for _ in range(300)]
    out = packing.deal(lengths)
    assert [sum(p[1] for p in parts) for parts in out] == lengths
    fill = Counter()
    for parts in out:
        for _, n, seq, _ in parts:
            fill[seq] += n
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(lengths) // 2048)


PAGE = "<html><head><title>T</title><script>var a='</p><article>no';</script></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>Accept</div><article><header>By A</header><h1>Head &amp; shoulders</h1><p>First <b>bold</b>ly<br>line<p>Second&nbsp;part <i>un</i>closed</p><form>Sign <input name=a></form><section id=comments>First!</section></article><aside>More</aside><footer>&copy;</footer></body></html>"


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><div class='sidebar'>Links</div><article><p>The text</p></article></div>",
        "<div id='page' class='site-search-enabled'><nav>Home</nav><main><p>The text</p></main></div>",
        "<form id=aspnet><div class=menu>Menu</div><article>The text</article></form>",
        "<aside class=sidebar><article>The text</article></aside><footer>Foot</footer>",
        "<body><div class=header>Top</div><p>The text</p></body>",
        "<div class='site-footer left-nav'>x</div><div class='cookie-notice'>y</div><p>The text</p>",
        "<article>The text</article><section id=comments><article>A longer comment than the text is</article></section>",
        "<article><p title=\"x>The text</p></article><p class=\"y\">after</p>",
        "<article><p title='a > b' data-x=\"<i>\">The text</p></article>",
        "<article><p class=a class=nav>The text</article>",
        "<article>The text</article><p title=\"never closed",
    ],
)
def test_html_keeps_articles_in_any_wrapper(page):
    assert html.main_text(page) == "The text"


def test_html_words_of_articles_that_sound_like_noise():
    page = "<article><section class='related-work'>One</section><p class='form-of-words'>Two</p><div class='header-study'>Three</div><div class=share>No</div></article>"
    assert html.main_text(page) == "One Two Three"
    assert html.main_text("<div class=sidebar>" + "All of the text. " * 20 + "</div>") == ("All of the text. " * 20).strip()


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<", "<p title=\"x>", "<!--", "<b><i>", "</b>", "<script>", "<li><div>", "a<b c='"])
def test_html_scans_malformed_pages_in_linear_time(piece):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html.main_text(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_html(spark):
    assert html.main_text(PAGE) == "Head & shoulders First boldly line Second part unclosed"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("plain <b>text") == "plain text"
    rows = [(i, f"https://a.example/{i}", f"<body><div><span>Menu of the site</span></div><div class=t><p>Own text number {i} {i * 7}</p></div></body>") for i in range(8)]
    rows += [(90, "https://b.example/1", "<body><div><span>Menu of the site</span></div></body>"), (91, None, None), (91, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extract(pages.withColumn("text", F.lit(3))).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter([*((i, f"Own text number {i} {i * 7}") for i in range(8)), (90, "Menu of the site"), (91, ""), (91, "")])
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("different", [5, 20])
def test_html_copies_count_once(spark, different):
    page = "<body><div><span>Menu of the site</span></div><article><p>Own text number {0} {1}</p></article></body>"
    rows = [(i, "https://a.example/", page.format(i, i * 7)) for i in [*range(different), *[0] * 1000]]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter((i, f"Own text number {i} {i * 7}") for i, _, _ in rows)


def test_html_deep_pages():
    deep = "<div>" * 3000 + "<p>own text</p><nav>MENU</nav><form>FORM</form>" + "</div>" * 3000 + "<p>after</p>"
    assert html.main_text(deep) == "own text after"
    assert html.main_text("<article>" + "<div>" * 1500 + "in</article>out<p>more</div></article><p>x") == "in"


def brute_importance(pages, min_pages, support):
    """Style tree of one host from its pages, straight from the definition."""
    from lumenframe.llm.html import DECAY, INLINE, OWN, RAW, VOID, Node, parse

    def fold(n, path):
        """(style children, own text, linked words) of a block; children are (style, path, subtree)."""
        kids, text, linked = [], [], []

        def walk(m, link=False):
            for c in m.children:
                if isinstance(c, str):
                    text.append(c)
                    linked.extend(c.split() if link else [])
                elif c.tag in RAW:
                    continue
                elif c.tag in INLINE or c.tag in VOID or c.tag in ("html", "body", "head"):
                    walk(c, link or c.tag == "a")
                else:
                    sub = fold(c, (*path, c.path))
                    if sub[0] or sub[1]:
                        kids.append((c.style, c.path, sub))

        walk(n)
        own = " ".join(" ".join(text).split())
        if kids and own:
            kids.append((OWN, ("own", path[-1]), ([], own, len(linked))))
        return (kids, "", 0) if kids else (kids, own, len(linked))

    found = {}

    def gather(page, path, sub):
        styles = tuple(k[0] for k in sub[0])
        found.setdefault(path, []).append((page, styles, repr(sub), [k[1] for k in sub[0]], len(sub[1].split()), sub[2]))
        for _, p, s in sub[0]:
            gather(page, p, s)

    distinct = {repr(t): t for t in (fold(parse(p), (0,)) for p in pages)}
    for k, t in enumerate(distinct.values()):
        gather(k, 0, t)
    held = {p: x for p, x in found.items() if len({y[0] for y in x}) >= max(min_pages, support * len(distinct))}

    def entropy(values):
        counts, n = Counter(values), len(values)
        return 1.0 if n == 1 else -sum(c / n * np.log(c / n) for c in counts.values()) / np.log(n)

    def importance(path):
        if path not in held:
            return 1.0
        rows = held[path]
        if not any(r[3] for r in rows):
            return entropy([r[2] for r in rows]) * (1 - sum(r[5] for r in rows) / max(1, sum(r[4] for r in rows)))
        styles = Counter(r[1] for r in rows)
        mean = np.mean([np.mean([importance(c) for c in r[3]]) if r[3] else 1.0 for r in rows])
        keep = DECAY ** len(styles)
        return (1 - keep) * entropy([r[1] for r in rows]) + keep * mean

    return sorted(round(importance(p), 4) for p in held)


def test_html_importance_equals_brute_force(spark):
    rng = random.Random(12)
    pages = []
    for i in range(60):
        items = "".join(f"<li><a href='/{k}'>{rng.choice(['Home', 'News', 'About'])}</a></li>" for k in range(rng.choice([3, 3, 3, 4])))
        rare = "<table><tr><td>rare</td></tr></table>" if i < 3 else ""
        pages.append(f"<body><div class=top>Same text</div><ul>{items}</ul><div class=main>{'lead' * (i % 2)}<h1>{prose(rng, 3)}</h1>{'<p>' + prose(rng, 5) + '</p>' if i % 3 else '<blockquote>x</blockquote>'}{rare}</div>{'<p>end</p>' * (i % 4 == 0)}</body>")
    pages += pages[:5] * 4 + [None]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    for min_pages, support in ((5, 0.01), (5, 0.3)):
        rows = [r.asDict() for r in html.tree(df, min_pages, support).collect()]
        assert sorted(round(x, 4) for x in html.importances(rows).values()) == brute_importance(pages, min_pages, support)
    low = {round(r.importance, 4) for r in html.unimportant(df).collect()}
    assert low and max(low) < html.LOW


def test_html_tree_decides_alone(spark):
    """Without marks: constant blocks and menus of a constant look go, own content stays."""
    rng = random.Random(2)
    page = "<body><div class=a><div>Same words</div><div>everywhere</div></div><div class=b><h2>{}</h2><p>{}</p></div><div class=c>Imprint</div></body>"
    own = [(prose(rng, 3), prose(rng, 20)) for _ in range(30)]
    rows = [(i, "https://a.example/", page.format(*x)) for i, x in enumerate(own)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), marks=False).collect()}
    assert got == {i: " ".join(" ".join(x).split()) for i, x in enumerate(own)}


def test_html_tree_finds_menus_that_differ(spark):
    """Without marks: menus go on every page though no two read the same, as all their words are links; a text with a link stays."""
    rng = random.Random(3)
    page = "<body><ul class=top>{}</ul><div class=b><p>{} <a href=x>{}</a></p><p>{}</p></div></body>"
    parts = [("".join(f"<li><a href=/{k}>{prose(rng, 2)} {rng.random()}</a></li>" for k in range(rng.randint(3, 5))), prose(rng, 20), prose(rng, 2), prose(rng, 9)) for _ in range(30)]
    df = spark.createDataFrame([(i, "https://a.example/", page.format(*x)) for i, x in enumerate(parts)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df, marks=False).collect()}
    assert got == {i: " ".join(" ".join(x[1:]).split()) for i, x in enumerate(parts)}


def naive_components(prints):
    ids = {}
    for d, f in prints:
        ids.setdefault(f, []).append(d)
    fs, root = list(ids), {f: f for f in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least: dict = {}
    for f in fs:
        least.setdefault(find(f), []).extend(ids[f])
    return Counter((d, f, min(least[find(f)])) for f in fs for d in ids[f])


@pytest.mark.parametrize("limit", [2, 32])
def test_links_equal_all_pairs(spark, limit):
    rng = random.Random(limit)
    prints, centre = [], rng.getrandbits(64)
    for i in range(150):
        f = centre if i % 3 == 0 else rng.getrandbits(64) if i % 3 == 1 else prints[rng.randrange(len(prints))][1]
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        prints.append((i, f - (1 << 64) if f >> 63 else f))
        prints[-1] = (i, f)
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in prints]
    roots = {r.node: r.root for r in simhash.components(simhash.links(simhash.checkpoint(spark.createDataFrame([(f,) for f in {f for _, f in signed}], "fp long")), limit)).collect()}
    by: dict = {}
    for d, f in signed:
        by.setdefault(roots.get(f, f), []).append(d)
    assert Counter((d, f % (1 << 64), min(by[roots.get(f, f)])) for d, f in signed) == naive_components(prints)


def test_tally_keeps_pairs_of_six_common_bytes(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for _ in range(300):
        f = rng.choice(base)
        for k in rng.sample(range(8), rng.randint(0, 4)):
            f = f & ~(0xFF << 8 * k) | rng.randrange(256) << 8 * k
        prints.add(f)
    common = lambda a, b: sum((a ^ b) >> 8 * k & 0xFF == 0 for k in range(8))
    want = {(a, b) for a in prints for b in prints if a != b and common(a, b) >= simhash.MIN_BYTES}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.tallied(simhash.index_of(df)).collect()}
    assert got | {(b, a) for a, b in got} == want


def test_simhash(spark, tables, docs):
    import xxhash

    def brute(t):
        w = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").strip(" \t\n\x0b\x0c\r"))
        w = [x for x in w if x]
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = queries.op6_simhash_bytes(spark, tables["full"]).where("doc_id IS NOT NULL").collect()
    prints = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == naive_components([p for p in prints if p[0] is not None])
    stay = simhash.dedup(docs)
    assert stay.columns == docs.columns and stay.count() == len({r.component_id for r in got} | {None})
    extra = spark.createDataFrame([(1, "a b", "x", "p"), (1, "a b", "x", "p"), (2, "a b", "y", "q"), (None, "c d e f", "z", "r"), (None, "c d e f", "z", "r"), (3, "", None, None)], "doc_id long, text string, _fp string, _key string")
    assert Counter(tuple(r) for r in simhash.dedup(extra).collect()) == Counter([(1, "a b", "x", "p"), (None, "c d e f", "z", "r"), (3, "", None, None)])


def test_near_dedup_stage(spark, docs):
    import corpus_pipeline

    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared, texts = fresh(30), []
    for k in range(40):
        w = fresh(rng.randint(60, 300)) + shared * (k % 3 > 0)
        texts.append(w)
        # from one changed word to far under the limit, and chains of copies of copies
        for _ in range(5):
            w = list(w)
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
            texts.append(w)
    base = fresh(150)
    for _ in range(60):  # one large group: copies of one text
        w = list(base)
        for at in rng.sample(range(150), 3):
            w[at] = f"w{rng.randrange(3000)}"
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(1000, "a b c d"), (1001, "A b  c d"), (1002, "a b c e"), (1003, None), (1004, " ")]
    sets = {i: {tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))} for i, t in rows for x in [words((t or "").lower())]}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    want = {r for r in root.values()}
    assert len(want) < len(rows) - 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").select("doc_id").collect()]
    assert sorted(got) == sorted(want)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_dedup_goes_by_simhash_first(spark, monkeypatch):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    bit = lambda a, b: ((simhash.fingerprint_of(a) ^ simhash.fingerprint_of(b)) % (1 << 64)).bit_count()
    rows, near, far = [], [], []
    while len(near) < 5 or len(far) < 5:
        w = fresh(400)
        one, two = " ".join(w), " ".join(f"x{k}" if k in ((50,), (50, 100, 150, 200, 250))[len(near) == 5] else x for k, x in enumerate(w))
        kind = near if bit(one, two) <= simhash.MAX_BITS else far if bit(one, two) > 4 else None
        if kind is not None and len(kind) < 5:
            kind.append({2 * len(rows), 2 * len(rows) + 1})
            rows.append((one, two))
    df = spark.createDataFrame([(2 * i + k, t) for i, r in enumerate(rows) for k, t in enumerate(r)], "doc_id long, text string")
    tables = {t.name for t in spark.catalog.listTables()}
    every, rounds, real = nearsets.representatives(df), [], nearsets.similar
    assert {t.name for t in spark.catalog.listTables()} == tables
    ids = {r.fp: r.id for r in every.collect()}
    monkeypatch.setattr(nearsets, "similar", lambda pairs, texts: rounds.append([{ids[r.a], ids[r.b]} for r in pairs.collect()]) or real(pairs, texts))
    found = [{ids[r.a], ids[r.b]} for r in nearsets.links(every).collect()]
    # the tally of positional bytes finds the pairs within its bound, and the set index is left with the others
    assert sorted(map(sorted, rounds[0])) == sorted(map(sorted, near))
    assert not any(p in later for p in near for later in rounds[1:])
    assert sorted(map(sorted, found)) == sorted(map(sorted, near + far))


def test_near_dedup_leaves_little_on_disk(spark):
    import gc
    import time
    from pathlib import Path

    from lumenframe.llm._shared import shared_dir

    rng = random.Random(21)
    letters = "abcdefghijklmnopqrst"
    rows = []
    for i in range(150):  # each text with a copy that differs in some words far apart
        w = ["".join(rng.choice(letters[:6]) for _ in range(4)) for _ in range(1500)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join("x" if k % 150 == 0 else x for k, x in enumerate(w)))]
    size = sum(len(t) for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    jvm, setting = spark.sparkContext._jvm, spark.conf.get(key)
    shuffles = lambda: {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    stored = lambda: {p: p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet")}
    gc.collect()
    files, tables = shuffles(), stored()
    out = nearsets.dedup(df)
    for _ in range(50):  # files go in the background
        if not (left := shuffles() - files):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key) == setting
    # texts are stored once for all and once for the pairs, and their sets, which are longer, not at all
    assert sum(n for p, n in stored().items() if p not in tables) < 2 * size
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(0, 300, 2))
    assert out.count() == out.count() == 150


def test_near_dedup_keeps_columns_of_any_name(spark):
    names = ["fp", "bits0", "print", "first", "key", "root", "size", "id", "c0", "r", "a.b"]
    rows = [(i, f"one two three four five six {i // 2}", *[f"{n}{i}" for n in names]) for i in range(6)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = {tuple(r) for r in nearsets.dedup(df).collect()}
    assert got == {r for r in rows if r[0] % 2 == 0}


def test_imatch(spark, tables, docs):
    got = queries.op7_imatch(spark, tables["full"]).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    assert len(got) == len(rows)
    want = Counter()
    for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = a.text or "", len(a.text or "")
        want[(a.doc_id, n, sha256((t[: n - n // 2] + (b.text or "")[: n // 2]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    text = {r.doc_id: r.text for r in rows}
    same = {}
    for d, t in text.items():
        assert same.setdefault(t or "", by[d].fingerprint) == by[d].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_imatch_chunks_give_each_row_its_next(spark, docs, monkeypatch):
    monkeypatch.setattr(imatch, "CHUNK_ROWS", 7)
    lone = imatch.in_chunks(docs)
    assert lone.where("NOT guest").count() == docs.count() and lone.select("chunk").distinct().count() > 5


def test_chat_round_trip(spark):
    rng = random.Random(8)
    bits = ["<", "|", "~", "n", "\n", "<|im_end|>", "<|im_start|>", "a", "<~|", "<n|", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", None, "a<n|b", "x\ny"]), rng.choice([None, "", "".join(rng.choices(bits, k=6))])) for c in [1, 2, 2, 3, None] for t in (2, None, 0, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: x)
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\nhi<|im_start|><|im_end|>\n")


def test_line_dedup(spark):
    rows = [(i, "h", f"Shared line \nown {i}\n\nrare" if i < 6 else f"own {i}\n Shared line") for i in range(12)] + [(99, "h", rows_text) for rows_text in ["copy\nof it"] * 9]
    rows += [(50, None, None), (51, "g", "Shared line"), (52, "h", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = Counter(tuple(r) for r in linededup.drop_boilerplate(df, ratio=0.5).select("doc_id", "text", "n_dropped").collect())
    want = Counter()
    for d, s, t in rows:
        new = None if t is None else "\n".join(x for x in t.split("\n") if not (s == "h" and x.strip() == "Shared line"))
        want[(d, new, 0 if t is None else t.count("Shared line") * (s == "h"))] += 1
    assert got == want


def test_langid(spark):
    rng = random.Random(3)
    vocab = {"en": ["the", "house", "with", "they", "thing"], "fr": ["les", "été", "que", "vous", "chaque"], "de": ["und", "nicht", "über", "schön", "eine"]}
    rows = [(i, " ".join(rng.choices(vocab[x], k=30)), x) for i, x in enumerate(rng.choices(list(vocab), k=400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 5 <> 0"))
    got = langid.predict(df, model).where("doc_id % 5 = 0").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the house with"), (5, "\u0301\u0302"), (6, "ѢѮѰ ѱѳѵ ҂ѿ"), (7, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.predict(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 5, 7)] == ["und"] * 5 and not out[6].accepted and out[4].accepted and out[4].lang_pred == "en" and not out[1].accepted
    assert all(r.accepted for r in got)
    nothing = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    good = docs.join(labels, "doc_id", "left_semi").where("size(split(text, ' ')) > 60")
    assert kept.join(labels, "doc_id", "left_semi").count() >= good.count() * 0.98
    assert corpus_pipeline.run(spark, sf).count() > 100




def executions(spark, run):
    """How many queries Spark runs for ``run``, and what it gives."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    last = max([x.executionId() for x in (store.executionsList().apply(k) for k in range(store.executionsList().size()))], default=-1)
    out = run()
    bus.waitUntilEmpty(30_000)
    return sum(store.executionsList().apply(k).executionId() > last for k in range(store.executionsList().size())), out


def test_few_queries_a_step(spark):
    """The driver keeps memory of each query: a round of components is one and its test another, a core is none of its own."""
    edges = spark.createDataFrame([(5, 1), (7, 1), (9, 2)], "a long, b long")
    n, roots = executions(spark, lambda: simhash.components(edges))
    assert n == 3 and sorted(map(tuple, roots.collect())) == [(5, 1), (7, 1), (9, 2)]
    chain = spark.createDataFrame([(k + 1, k) for k in range(20)], "a long, b long")
    assert sorted(map(tuple, simhash.components(chain).collect())) == [(k, 0) for k in range(1, 21)]
    two = spark.createDataFrame([(9, 1), (9, 3), (4, 3)], "a long, b long")
    assert sorted(map(tuple, simhash.components(two).collect())) == [(3, 1), (4, 1), (9, 1)]
    assert simhash.components(edges.limit(0)).count() == 0
    at = spark.createDataFrame([("g", 0, k, 0, 0, 0, k // 2) for k in range(10)], "_g string, _s int, _f0 long, _f1 long, _f2 long, _f3 long, _b long")
    n, core = executions(spark, lambda: quality._core(at, 0.5, 1))
    assert n == 0 and sorted(r._f0 for r in core.collect()) == list(range(6))


def test_sample_of_languages_is_not_collected_as_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(f"{w} {k} {w}", lang) for k in range(30) for w, lang in (("the house and", "en"), ("das haus und", "de"))], "text string, lang string")
    frame, collect = type(rows), type(rows).collect

    def rowwise(self):
        assert "bucket" not in self.columns
        return collect(self)

    monkeypatch.setattr(frame, "collect", rowwise)
    model = langid.train(rows)
    assert model.langs == ["de", "en"] and model.predict("the house and 99")[0] == "en" and model.predict("das haus und 99")[0] == "de"
    assert langid.train(rows.limit(0)).langs == []
