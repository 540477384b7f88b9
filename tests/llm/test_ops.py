"""The ten operators against brute force, round trips and held-out labels, and on nulls, empty texts, ties, repeats and odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
from oracle import assert_same, duck
from pyspark.sql import functions as F

from porelake.llm import decontaminate, graph, html, langid, licences, packing, quality, queries, simhash, store, tokencount, tokens, warc

SF = "/root/testdata/sf0.01"
ROW = "doc_id long, text string, lang string, source string, n_chars long"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "src1", 0),
    (3, "   \n\t ", "en", "src1", 0),
    (4, "The same words again and again here.", "en", None, 5),
    (4, "The same words again and again here.", "en", None, 5),
    (5, LONG, "fr", "src2", 9),
    (None, "An id is missing from this row of text.", None, "src2", 9),
    (6, "Ünïcode — “quotes” 日本語 😀 nbsp \x1c sep", "de", "src3", 9),
    (7, "The same words again and again here!", "en", "src3", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with more columns whose names clash with those that operators use inside."""
    rows = spark.createDataFrame(ODD, ROW)
    return rows.withColumn("fp", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("length", F.lit("y")).withColumn("score", F.lit(0.5)).withColumn("lang_pred", F.lit("kept"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ROW)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


# --- 1 ---


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(codes, radius):
    forest = graph.Forest()
    ids = sorted(codes)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                forest.union(a, b)
    return {i: forest.find(i) for i in ids}


def test_simhash_against_all_pairs(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    codes = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in list(texts)[:150]:
        assert codes[i] == plain_fingerprint(texts[i])
    assert {r.doc_id: r.component_id for r in rows} == plain_components(codes, 4)


def test_keys_grow_with_the_number_of_fingerprints():
    assert [simhash.spare_for(n, 4) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**13)] == [2, 2, 2, 3, 4, 6]


@pytest.mark.parametrize("tree_size, spare", [(7, None), (4096, None), (4096, 3), (7, 4)])
def test_links_connect_what_brute_force_connects(spark, tree_size, spare):
    rng = random.Random(3)
    codes = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice((1, 3, 30))):
            code = base
            for _ in range(rng.randint(0, 6)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    df = spark.createDataFrame(signed, "fp long")
    got = simhash.links(df, tree_size=tree_size, spare=spare).collect()
    forest = graph.Forest()
    for a, b in got:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        forest.union(a, b)
    want = plain_components({c: c & (1 << 64) - 1 for (c,) in signed}, 4)
    same = defaultdict(set)
    for (c,) in signed:
        same[want[c]].add(forest.find(c))
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)


def test_bk_tree_finds_all_in_radius():
    rng = random.Random(5)
    codes = [rng.getrandbits(16) for _ in range(400)]
    codes = list(dict.fromkeys(codes))
    tree = simhash.BKTree(3)
    for c in codes:
        tree.add(c)
    for q in range(0, 1 << 16, 991):
        assert {codes[i] for i in tree.search(q, lambda at: False)} == {c for c in codes if (c ^ q).bit_count() <= 3}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(1, 1), (7, 5)]
    got = {r.vertex: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 5 for k in range(6, 40)}, **{k: 100 for k in range(101, 161)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(odd, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for i, f, c in got:
        by[i].add((f, c))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)} and len(by[4]) == 1
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.first_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == ids[3] == 0 and ids[4] == 1 and ids[None] == 1


# --- 2 ---


def test_decontamination_by_hand(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "again and again"), (3, None), (4, "..."), (None, "nbsp"), (10, "Words"), (10, "Words")], "item_id long, text string").withColumn("n_words", F.lit(1))
    docs = spark.createDataFrame([(1, "x A b-c d e f g h i j, k y"), (2, "again and again and AGAIN"), (3, "words"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.find_contamination(docs, items)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (13, 11, 1)
    assert (got[2].n_words, got[2].n_hit, got[2].n_items) == (5, 5, 1) and got[2].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert got[3].contaminated and got[3].items_sha256 == hashlib.sha256(b"10").hexdigest()
    assert not got[4].contaminated and got[4].items_sha256 == hashlib.sha256(b"").hexdigest() and got[4].n_words == 0
    assert decontaminate.find_contamination(odd, items).count() == len(ODD)
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(decontaminate.find_contamination(odd, items.limit(0))).collect())


def test_passes_give_what_one_pass_gives(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = docs.unionByName(docs.where("doc_id < 40"))
    rows = lambda x: sorted(map(repr, decontaminate.report(x).collect()))
    assert rows(decontaminate.find_contamination(some, items)) == rows(decontaminate.find_contamination(some, items, table_bytes=3000))


def test_wu_manber_against_plain_search():
    rng = random.Random(1)
    for _ in range(300):
        text = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for i in range(rng.randint(1, 6))] + [(None, "a b c"), ("n", None)]
        spans, found = set(), set()
        for i, item in items:
            seq = (item or "").split()
            size = min(4, len(seq))
            for k in range(len(seq) - size + 1 if seq else 0):
                for at in range(len(text) - size + 1):
                    if text[at : at + size] == seq[k : k + size]:
                        spans.update(range(at, at + size))
                        found.add(i)
        n, got, ids = decontaminate.Matcher(items, 4).scan(" ".join(text))
        assert n == len(text) and {p for a, b in got for p in range(a, b)} == spans and ids == sorted(found - {None})


def test_tables_are_small():
    """Bytes of the tables for each byte of benchmark text, dictionary aside."""
    rng = random.Random(2)
    items = [(str(i), " ".join(f"w{rng.randrange(5000)}" for _ in range(400))) for i in range(100)]
    made = decontaminate.Matcher(items)
    size = sum(x.nbytes for s in made.searches for x in (s.shift, s.bucket, s.starts, s.items)) + made.searches[0].stream.nbytes
    assert size < 12 * sum(len(t) for _, t in items) and len(made.searches) == 1


# --- 3 ---


def test_language_held_out(docs):
    rows = langid.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(held) > 200
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_gradients_are_those_of_the_loss():
    net = langid.BiGRU.fresh(["a", "b"], hidden=3, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (6, 4)).astype(np.int16), np.array([0, 1, 1, 0])
    loss = lambda: net.gradients(x, y)[0]
    _, grads = net.gradients(x, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = net.p[name][at], 1e-2
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert g[at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4), name


def test_language_odd_rows(odd, empty):
    got = langid.identify(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ODD) and rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[5].lang_pred in ("en", "fr", "de")
    assert langid.identify(empty).count() == 0
    kept = langid.known_language(odd)
    assert kept.columns == odd.columns and {r.lang_pred for r in kept.collect()} == {"kept"}
    shared = odd.sparkSession.createDataFrame([(None if i % 2 else 7, f"{'the words of this one' if i % 3 else 'les mots de celui'} {i}", "en" if i % 3 else "fr") for i in range(4000)], "doc_id long, text string, lang string")
    assert set(langid.learn(shared).langs) == {"en", "fr"}  # ids that half of the rows share, or that are missing
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


# --- 4 ---


def test_extraction():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy &amp; buy and buy some more of it now</div><article><header><h1>Head\n line</h1></header><p>One <b>bo</b>ld &lt;word&gt; in a&nbsp;paragraph that is long enough.<p>Two.<br>More text in this second paragraph, long too.</p><div class=comments><p>A reader said something rather long here.</p></div></article><aside>Side</aside><footer>&copy; someone with a long line of legal words</footer>"
    assert html.main_text(page) == "Head line One bold <word> in a paragraph that is long enough. Two. More text in this second paragraph, long too."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>only</nav>") == ""
    assert html.main_text("<p>plain paragraph without any article element, which is long") == "plain paragraph without any article element, which is long"
    assert html.main_text("<![bad <p>text that stays whatever the declaration is") != ""
    assert "x" * 1000 in html.main_text("<article><p>" + "x" * 300_000)


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<article><p>Some text", 2)], "page_id long, url string, html string, text int")
    got = html.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 9), (1, 0), (1, 0)]
    assert html.extract(pages.limit(0)).count() == 0


# --- 5 and 10 ---


@cache
def plain_tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def plain_ids(path, text):
    return plain_tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_ids_are_exact(path):
    import pyarrow as pa

    rng = random.Random(7)
    texts = [t for _, t, *_ in ODD if t is None or len(t) < 1000] + ["".join(rng.choice(" \n\tab.,'é1😀ß") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["<|endoftext|>", "a\nb\nC.", "don't", "x  y   z", "\n\n\na"]
    enc = tokens.Encoder(path)
    ids, edges = enc.encode_batch(pa.array(texts), 9)
    want = enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for t, a, b, w in zip(texts, edges, edges[1:], want):
        assert ids[a:b].tolist() == [*w.ids, 9], repr(t)
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == w.ids


def check_packing(rows, ids_of, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs):
    rows = packing.packed(docs, WORD).collect()
    got = {(r.doc_id, r.piece): r for r in rows}
    total = 0
    for d in docs.limit(200).collect():
        ids = [*plain_ids(WORD, d.text), 0]
        for k in range(0, len(ids), 2048):
            r, part = got[d.doc_id, k // 2048], ids[k : k + 2048]
            assert (r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    total = sum(r.length for r in rows)
    assert check_packing(rows, None) <= min(1.01 * -(-total // 2048) + 1, plain_best_fit([r.length for r in rows], 2048))


def plain_best_fit(sizes, capacity):
    rooms = []
    for n in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def check_rules(rules, sizes, capacity):
    used = defaultdict(list)
    for length, low, high, first, per, offset in rules:
        for k in range(high - low):
            used[first + k // per].append((offset + k % per * length, length))
    assert Counter(n for parts in used.values() for _, n in parts) == Counter(sizes)
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(used)


def test_sweeps_of_ranges_are_best_fit_decreasing():
    """The supersteps by hand, with any number of ranges: as many sequences as sequential best-fit decreasing."""
    rng = random.Random(2)
    for trial in range(80):
        top = rng.choice((10, 50))
        sizes = [rng.randint(1, top) for _ in range(rng.randint(0, 300))]
        docs, gaps, rules, used, parts = [(n, 0, k) for n, k in Counter(sizes).items()], [], [], 0, rng.choice((1, 3, 7))
        while docs:
            left, free = [], []
            for p in range(parts):
                found = packing.sweep([x for x in docs if (x[0] - 1) * parts // 50 == p], [x for x in gaps if (x[0] - 1) * parts // 50 == p], 50)
                rules += found[0]
                left += found[1]
                free += found[2]
            more, docs, gaps = packing.sweep(left, free, 50)
            rules += more
            if docs:
                n = packing.opened(docs, 50)
                gaps.append((50, used, used + n))
                used += n
        assert check_rules(rules, sizes, 50) <= plain_best_fit(sizes, 50)


@pytest.mark.parametrize("seed", [0, 1])
def test_rules_are_best_fit_decreasing(spark, seed):
    rng = random.Random(seed)
    sizes = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(700)]
    rows = packing.best_fit(spark.createDataFrame(list(Counter(sizes).items()), "length long, n long")).collect()
    assert check_rules([tuple(r) for r in rows], sizes, 2048) <= plain_best_fit(sizes, 2048)
    assert packing.best_fit(spark.createDataFrame([], "length long, n long")).count() == 0


def test_packing_odd_rows(odd, empty):
    rows = packing.packed(odd, WORD).collect()
    check_packing(rows, None)
    assert sum(r.doc_id == 1 for r in rows) == 1 and sum(r.doc_id == 4 for r in rows) == 2 and packing.packed(empty, WORD).count() == 0


def test_store_round_trip(spark, odd, empty, docs):
    some = odd.select("doc_id", "text").unionByName(docs.where("doc_id between 100 and 160").select("doc_id", "text"))
    made = store.write_store(some, BYTE)
    read = {(r.doc_id, r.part, r.place): np.frombuffer(r.ids, "<u4").tolist() for r in store.read_store(spark, made).collect()}
    want = Counter((r.doc_id, tuple([*plain_ids(BYTE, r.text), 2])) for r in some.collect())
    assert Counter((k[0], tuple(v)) for k, v in read.items()) == want
    index = spark.read.parquet(f"{made.path}/index")
    assert index.count() == index.select("digest").distinct().count()
    rows = store.round_trip(some, BYTE).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((k, len(v), crc(v)) for k, v in want.elements())
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert store.round_trip(empty, BYTE).count() == 0


def test_damaged_store_is_noticed(spark, docs):
    made = store.write_store(docs.where("doc_id < 5"), BYTE)
    import glob

    for path in glob.glob(made.path.removeprefix("file://") + "/packs/*.pack"):
        data = bytearray(open(path, "rb").read())
        data[len(data) // 2] ^= 0xFF
        open(path, "wb").write(data)
    with pytest.raises(Exception):
        store.read_store(spark, made).collect()


def test_chunks_shift_with_their_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50_000, 40_000).astype(np.uint32)
    b = np.concatenate([rng.integers(0, 50_000, 37).astype(np.uint32), a])

    def chunks(x):
        ends = store.cuts(len(x), store.rolling_ends(x).tolist())
        return {x[i:j].tobytes() for i, j in zip([0, *ends], ends)}

    assert len(chunks(a) & chunks(b)) > 0.8 * len(chunks(a))
    assert store.merkle_root([b"a", b"b"]) != store.merkle_root([b"b", b"a"]) and store.merkle_root([]) != store.merkle_root([b"a"])


# --- 6 ---


def test_archive_lookup_and_read(spark):
    rows = [(k, f"http://Www{k % 3}.Example.com:80/p{k % 7}?q#f", f"<p>{'x' * (k % 4)}", 1) for k in range(50)] + [(50, None, None, 1), (None, "not a url", "<p>odd", 1), (3, "http://www0.example.com/p3?q", "<p>xxx", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int")
    made = warc.write_archive(pages)
    keys = spark.createDataFrame([("com,example,www1)/p4?q",), ("nothing",), ("com,example,www1)/p4?q",)], "key string")
    found = warc.read_records(made, warc.lookup(spark, made, keys)).collect()
    assert {r.page_id for r in found} == {k for k in range(50) if k % 3 == 1 and k % 7 == 4}
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    winners = {c: max(k for k in range(50) if k % 4 == c) for c in range(4)}
    for r in got:
        if r.page_id is not None and r.page_id < 50:
            w = winners[r.page_id % 4]
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == w else ("revisit", w)) and r.payload_bytes == 3 + r.page_id % 4
    assert next(r for r in got if r.page_id == 50).payload_bytes == 0
    assert {r.record_type for r in warc.round_trip(pages, least_revisit=100).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_are_standard_members():
    import gzip

    member = warc.record(7, "http://a.b/\r\nx", b"body", hashlib.sha1(b"body").digest(), None, False)
    text = gzip.decompress(member)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response") and text.endswith(b"body\r\n\r\n") and b"%0D%0A" in text
    head, _, payload = warc.parse_record(member)
    assert payload == b"body" and head["WARC-Record-ID"] == "<urn:page:7>"


# --- 7 ---


def plain_count(scores, word):
    text = tokencount.MARK + word
    unknown = min(scores.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        found = [] if text[end - 1] in scores else [(best[end - 1][0] + unknown, best[end - 1][1] - n)]
        found += [(best[a][0] + scores[text[a:end]], best[a][1] - 1) for a in range(max(0, end - 99), end) if text[a:end] in scores]  # no piece is as long
        best.append(max(found))
    return -best[-1][1]


@pytest.mark.parametrize("shared", [300, 400_000])
def test_token_counts(docs, odd, empty, shared):
    scores = tokencount.unigram_scores(PIECE)
    some = docs.where("doc_id < 60").select("doc_id", "text").unionByName(odd.where("doc_id is null or doc_id != 5").select("doc_id", "text"))
    rows = tokencount.count_tokens(some.withColumn("word", F.lit(1)), PIECE, shared).collect()
    known = cache(lambda w: plain_count(scores, w))
    want = Counter((d.doc_id, len((d.text or "").split()), sum(map(known, (d.text or "").split()))) for d in some.collect())
    assert Counter(map(tuple, rows)) == want
    assert tokencount.count_tokens(empty, PIECE, shared).count() == 0


def test_scores_are_shared_by_prefixes():
    scores = tokencount.unigram_scores(PIECE)
    trie = tokencount.ForwardTrie(scores)
    for w in ["hello", "help", "helping", "hello", "日本", "日本語", "x" * 400, "", "x" * 401]:
        assert trie.count(tokencount.MARK + w) == plain_count(scores, w)
    assert {len(trie.best), len(trie.tokens)} == {403}


# --- 8 ---


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    rng = random.Random(4)
    own = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    notice = "Accept all cookies " + own(200)
    rows = [(k, f"{notice}\n{own(210)}", "h") for k in range(30)]  # boilerplate in mostly other text
    rows.append((100, f"{notice}\n{own(10)}", "h"))  # little but boilerplate
    rows.append((101, f"{notice}\n{own(49)}", "h"))  # too few words are left
    rows.append((102, f"{notice}\n{own(50)}", "h"))  # less than a fifth, 50 of 253
    rows.append((103, f"{notice}\n{own(10)}", "another host"))
    template = "\n".join(own(20) for _ in range(6))
    rows += [(200 + k, f"{template}\n{own(21)}", "t") for k in range(21)]  # a host of template pages, 15 % own words
    rows += [(300 + k, f"{template}\n{own(21)}", "u") for k in range(20)]  # just at the limit
    rows += [(400 + k, rows[-1][1], "u") for k in range(5)]  # exact copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(1))
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    rejected = {100, 101, 102, *range(200, 221)}
    assert not any(r.base_failed for r in got.values()) and {k for k, r in got.items() if not r.kept} == rejected
    assert got[100].n_removed_words == got[0].n_removed_words == 203 and got[103].n_removed_words == 0 and got[200].n_removed_words == 120
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - rejected


def test_quality_odd_rows(odd, empty):
    rows = quality.quality(odd).collect()
    assert len(rows) == len(ODD) and all(r.base_failed for r in rows if r.doc_id != 5) and quality.quality(empty).count() == 0
    assert quality.good_documents(odd).columns == odd.columns and [r.doc_id for r in quality.good_documents(odd).collect()] == [5]


def test_repeated_words():
    assert quality.repeated_words(b"a b c a b c".split()) == 6 and quality.repeated_words(b"a a a a".split()) == 4 and quality.repeated_words(b"a b".split()) == 0
    assert quality.repeated_words(b"x a b c y a b c z".split()) == 6


# --- 9 ---


def test_licences(spark, odd, empty):
    mit = licences.TEMPLATES[21][1]
    wrapped = mit.replace(", ", ",\n")
    docs = spark.createDataFrame(
        [(1, "Some text.\nReleased under the MIT License.\nMore."), (2, "licensed under CC-BY-NC 4.0"), (3, "Licensed under nothing"), (4, wrapped), (5, None), (6, "Licensed under the Apache license, version 2.0!\nThis work is licensed under the GNU General Public License, version 3.")],
        "doc_id long, text string",
    ).withColumn("spdx", F.lit("x"))
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert got[1].best == "MIT" and got[2].best == "CC-BY-NC-4.0" and got[3].n_matches == 0 and got[3].best is None and got[4].licences == "MIT" and got[5].score == 0
    assert got[6].licences == "Apache-2.0,GPL-3.0-only"
    assert licences.scan(odd).count() == len(ODD) and licences.scan(empty).count() == 0


def test_licences_at_the_threshold_and_in_longer_lines(spark):
    """Sizes are of distinct bigrams and bounds exact; notices are found within lines and licences across paragraphs."""
    whole = dict(licences.WHOLE)["ISC"]
    texts = [
        "This is Licensed under the MIT License.",  # Dice 0.8
        "Licensed under the MIT License. Licensed under the MIT License.",  # repeated bigrams
        "The code in question (c) 2024 somebody. Licensed under CC BY 4.0. And more words follow on the same line.",
        "This project is released under the MIT License.",
        f"My own words before it.\n\n{whole}\n\nAnd some words behind it that are no licence.",
        "Licensed under a License of another kind that MIT never saw.",
        "word " * 200_000 + "released under the MIT license",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[3])], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("own", F.lit(1))
    rows = licences.scan(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and got[0].best == got[1].best == got[3].best == got[6].best == got[None].best == "MIT"
    assert got[0].score == 1.0 and got[1].score == 1.0 and got[1].n_matches == 2  # the line and, once, the text
    assert got[2].best == "CC-BY-4.0" and "ISC" in got[4].licences.split(",") and got[5].n_matches == 0
    assert licences.bounds(4, 80) == (3, 6) and licences.bounds(5, 80) == (4, 7)


def test_licences_against_plain_dice(spark):
    rng = random.Random(9)
    few = (("A", "one two three four five six"), ("B", "two three five eight thirteen"), ("C", "one two one two three"))
    texts = [" ".join(rng.choice("one two three four five six eight thirteen x".split()) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    want = []
    for text in texts:
        words, found = text.split(), {}
        for spdx, template in few:
            other = set(licences.bigrams_of(template))
            for size in {len(words) - 1, min(len(words), len(template.split())) - 1}:
                for at in range(len(words) - size):
                    own = {f"{a} {b}" for a, b in zip(words[at : at + size], words[at + 1 : at + size + 1])}
                    if own and 200 * len(own & other) >= 80 * (len(own) + len(other)):
                        found[spdx] = max(found.get(spdx, 0), 2 * len(own & other) / (len(own) + len(other)))
        want.append((round(max(found.values(), default=0.0), 6), min((k for k in found if found[k] == max(found.values())), default=None)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.score, r.best) for r in licences.scan(docs, few).orderBy("doc_id").collect()] == want


def test_anchors_lose_no_match():
    rng = random.Random(6)
    for _, text in licences.TEMPLATES + licences.WHOLE:
        own = licences.bigrams_of(text)
        starts = set(licences.anchors(own, 80))
        for _ in range(50):
            other = {b for b in own if rng.random() < rng.choice((0.6, 0.8, 0.95))} | {f"q{k} r" for k in range(rng.randint(0, 5))}
            if 2 * len(other & set(own)) / (len(other) + len(set(own))) >= 0.8:
                assert other & starts


def test_licence_plan_is_native(spark, docs):
    plan = licences.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_keys_are_found_in_all_index_files(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 5}.org/{k % 9}", f"<p>{k}") for k in range(200)], "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = warc.write_archive(pages)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = warc.keys_of(pages)
    whole = warc.lookup(spark, made, keys).collect()
    assert spark.read.parquet(f"{made.path}/directory").select("file").distinct().count() > 1
    assert len({(r.file, r.offset) for r in whole}) == len(whole) == 200 and {r.key for r in whole} == {r.key for r in keys.collect()}
    assert warc.lookup(spark, made, keys.limit(0)).count() == 0
    found = warc.read_records(made, warc.lookup(spark, made, keys))
    assert found.where("payload like '<p>%'").count() == 200 and "payload" not in warc.read_records(made, keys.selectExpr("'' as file", "0L as offset", "0 as length").limit(0), payloads=False).columns


def test_made_folders_can_be_removed(spark, docs):
    from pathlib import Path

    from porelake.llm import common

    held = common.staged(docs.limit(3))
    path = Path(held.inputFiles()[0].removeprefix("file://")).parent
    kept = dict(common._MADE)
    common._MADE.clear()
    common._MADE[spark.sparkContext.applicationId] = [f"file://{path}"]
    common.remove_made(spark)
    assert not path.exists()
    common._MADE.update(kept)


def test_many_small_partitions_keep_their_numbers(spark, docs):
    """Partitions are put together before small tables are written; what is numbered by partition must not be."""
    many = docs.where("doc_id < 300").repartition(80)
    rows = packing.packed(many, WORD).collect()
    sequences = check_packing(rows, None)
    assert sequences <= 1.02 * sum(r.length for r in rows) / 2048 + 2
    at = 0
    for r in store.round_trip(many, BYTE).orderBy("doc_id").collect():
        assert r.start == at
        at += r.n_tokens
    assert at == sum(len(plain_ids(BYTE, r.text)) + 1 for r in docs.where("doc_id < 300").collect())
    few = spark.range(10).repartition(400)
    from porelake.llm.common import few_files

    assert few_files(few).rdd.getNumPartitions() < 400
