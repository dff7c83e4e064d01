"""The first ten operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import base64
import hashlib
import html as html_lib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from murmur.llm import _shared, decontamination, exact_dedup, html_text, packing, sharding, simhash, substring_dedup, token_counts, toxicity, warc
from murmur.llm._shared import components
from murmur.llm._tokens import default_path
from murmur.llm._words import distinct, utf8, words_of

SF, SF_LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ODD = ["", None, " ", "a", "a b", "  x\t\ty \n", "é é", "ΑΣ. ΑΣ.Α", "it's we'll 'x", "<|endoftext|>, <|endoftext|>x", "a\x1cb c d e", "1234 5,6.7 !!!...", "日本語 テキスト", "🙂🙂 ok", "﻿bom", "x" * 5000, "word. " * 3000, "a≠b"]


def docs_df(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], DOCS)


def with_clashes(df):
    """The same rows with columns named as operators name theirs."""
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(["id", "key", "run", "digest", "kept", "keep_id", "size", "shard", "slot", "fp", "component_id", "score", "start", "length", "ids", "edits", "is_open", "lang", "n_chars"])))


def rng(seed):
    return random.Random(seed)


# 1: exact dedup.


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_groups(spark, keep):
    r = rng(1)
    rows = [(k, r.choice(["x", "y", "", None, "Z" * 9000, f"u{k}"])) for k in range(300)] + [(7, "x"), (None, "y"), (None, "only null")]
    got = exact_dedup.dedup_groups(with_clashes(spark.createDataFrame(rows, DOCS)), keep=keep).collect()
    of = {}
    for i, t in rows:
        of.setdefault(t or "", []).append(i)
    pick = min if keep == "smallest" else max
    expected = []
    for i, t in rows:
        ids = [x for x in of[t or ""] if x is not None]
        stays = pick(ids) if ids else None
        expected.append((i, stays, len(of[t or ""]), i == stays, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_exact_dedup_keeps_one_row_and_all_columns(spark):
    df = with_clashes(spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, "")], DOCS))
    out = exact_dedup.exact_dedup(df, keep="largest")
    assert out.columns == df.columns
    assert sorted(x["doc_id"] for x in out.collect()) == [2, 4]


def test_exact_dedup_names_rows_by_id_and_text(spark):
    rows = [(None, "p"), (None, "q"), (None, "q"), (None, "a"), (1, "a"), (2, "b"), (2, "c"), (2, "c"), (3, "c")]
    for keep, of_c in (("smallest", 2), ("largest", 3)):
        out = exact_dedup.exact_dedup(with_clashes(spark.createDataFrame(rows, DOCS)), keep=keep).collect()
        assert sorted(((x["doc_id"], x["text"]) for x in out), key=str) == sorted([(None, "p"), (None, "q"), (1, "a"), (2, "b"), (of_c, "c")], key=str)


def test_exact_dedup_normalises(spark):
    out = exact_dedup.dedup_groups(docs_df(spark, ["A", "a", "b"]), normalise=F.lower).collect()
    assert sorted(x["group_size"] for x in out) == [1, 2, 2]


# 2: sharding.


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_balanced_and_gapless(spark, shards):
    r = rng(2)
    rows = [(k, "w" * r.randrange(50) + str(k % 400)) for k in range(3000)] + [(None, None), (5000, None), (5000, "")]
    df = with_clashes(spark.createDataFrame(rows, DOCS))
    out = sharding.shard(df, shards, rows_a_task=100).collect()
    assert len(out) == len(rows)
    sizes, slots, where = {}, {}, {}
    for x in out:
        assert x["size"] == len((x["text"] or "").encode()) + 1
        assert where.setdefault(x["text"] or "", x["shard"]) == x["shard"]
        sizes[x["shard"]] = sizes.get(x["shard"], 0) + x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert sorted(sizes) == list(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(sum(y["size"] for y in out if (y["text"] or "") == t) for t in {x["text"] or "" for x in out})
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest + 0.01 * sum(sizes.values()) / shards


def test_a_text_larger_than_a_shard(spark):
    rows = [(k, "hot text of many rows" if k % 3 else f"own {k}") for k in range(900)]
    out = sharding.shard(spark.createDataFrame(rows, DOCS), 8, rows_a_task=50).collect()
    assert len({x["shard"] for x in out if x["doc_id"] % 3}) == 1 and len(out) == 900


def test_splitters_count_exactly(spark):
    r = rng(3)
    keys = [r.randrange(1 << sharding.KEY_BITS) for _ in range(2000)]
    rows = spark.createDataFrame([(k, 1) for k in keys], "key long, size long")
    cuts = sharding.splitters(rows, 4, tolerance=0)
    assert [sum(k < c for k in keys) for c in cuts] == [500, 1000, 1500]


# 3 and 10: tokens.


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def odd_texts(seed, n=60):
    r, texts = rng(seed), pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()
    return ODD + texts[:20] + ["".join(r.choice([" ", "\n", "a", "Bc", "é", ",", ".", "'s", "7", "ß", "|", "́", "日", "Σ"]) for _ in range(r.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("group", [20, 20_000])
def test_packing_holds_every_id_once(spark, tokenizer, group):
    texts = odd_texts(4)
    out = packing.pack(with_clashes(docs_df(spark, texts)), group=group, capacity=256).collect()
    of, sequences = {}, {}
    for x in out:
        of.setdefault(x["doc_id"], []).append((x["start"], x["ids"]))
        assert x["length"] == len(x["ids"]) and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for k, t in enumerate(texts):
        expected = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert [i for _, ids in sorted(of[k]) for i in ids] == expected
        assert {x["doc_tokens"] for x in out if x["doc_id"] == k} == {len(expected)}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_a_vocabulary_whose_words_do_not_stand_alone(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts, whole = odd_texts(34, 10), Tokenizer.from_file(path)
    of = {}
    for x in packing.cut_documents(docs_df(spark, texts), capacity=64, vocabulary=path).collect():
        of.setdefault(x["doc_id"], []).append((x["start"], x["ids"]))
    assert all([i for _, ids in sorted(of[k]) for i in ids] == whole.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts))
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs_df(spark, texts), vocabulary=path)


def test_best_fit_takes_the_tightest_window():
    r = rng(5)
    lengths = [r.randrange(1, 65) for _ in range(500)]
    windows, offsets = packing.best_fit(lengths, 64)
    rooms, expected = [], [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(room, w) for w, room in enumerate(rooms) if room >= lengths[k]]
        if fits:
            tight = min(fits)[0]
            assert 64 - offsets[k] == tight
            rooms[windows[k]] -= lengths[k]
        else:
            assert windows[k] == len(rooms) and offsets[k] == 0
            rooms.append(64 - lengths[k])
        expected[k] = windows[k]
    assert min(rooms) >= 0


def test_token_counts_follow_edits(spark, tokenizer):
    r, texts = rng(6), odd_texts(7)
    rows, expected = [], {}
    for k, t in enumerate(texts):
        edits = [(r.randrange(-1, len(t or "") + 5), r.choice([0, 1, 2, 9, 10_000]), r.choice(["", " ", "new words, ", "x", "'s", "\n\n", None, "é"])) for _ in range(r.randrange(5))]
        x = t or ""
        for at, n, insert in edits:
            at = min(max(at, 0), len(x))
            x = x[:at] + (insert or "") + x[at + n :]
        rows.append((k, t, edits or None))
        expected[k] = (len(tokenizer.encode(t or "", add_special_tokens=False).ids), len(tokenizer.encode(x, add_special_tokens=False).ids), len(x), x)
    df = spark.createDataFrame(rows, DOCS + ", e array<struct<at int, n_delete int, insert string>>")
    out = token_counts.count_tokens(with_clashes(df), "e", with_text=True).collect()
    assert {x["doc_id"]: (x["n_tokens"], x["n_tokens_edited"], x["n_chars_edited"], x["text_edited"]) for x in out} == expected
    long = next(x for x in out if len(texts[x["doc_id"]] or "") > 9000)
    assert long["n_chars_reencoded"] < 0.2 * max(long["n_chars_edited"], 9000) or long["n_chars_edited"] < 9000


# 4: HTML.


def test_article_text_without_what_is_around_it():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
    <header><p>site</p></header><nav><ul><li><a href=x>menu</a></ul></nav><div class="cookie-notice">cookies</div>
    <article><h1>He&amp;ad</h1><p><b>One  two<br><p>thr&eacute;e <i>f</i>our<div class="ad">buy</div><form><input value=x>send</form>
    <aside>side</aside><section id="comments"><p>reader</p></section><p>end &lt;x&gt;</article><footer>&copy; f</footer>"""
    assert html_text.blocks(page)[0] == ["He&ad", "One two", "thrée four", "end <x>"]


@pytest.mark.parametrize("wrapper", ['<div class="content-sidebar-wrap"><main>{}</main></div>', '<div class="site-content no-sidebar"><article>{}</article></div>', '<body><div class="has-banner"><article>{}</article></div></body>', '<div id="menu" class="banner"><div role=main>{}</div></div>', "<form id=aspnetForm><div class=sidebar><article>{}</article></div></form>", "<main>{}</main>"])
def test_boxes_around_and_inside_an_article(wrapper):
    inside = '<p>one</p><section class="related-work"><p>two</p></section><p class="notice">three</p><div class="search-space">four</div><div class="ad">buy</div><div class="share-buttons">share</div>'
    page = f'<div class="sidebar"><p>side</p></div><div class="comments"><article>reader</article></div>{wrapper.format(inside)}<div class="cookie-notice">cookies</div>'
    assert html_text.blocks(page)[0] == ["one", "two", "three", "four"]


@pytest.mark.parametrize("box", ['<ol class="comment-list"><li>x</li></ol>', '<div class="comment">x</div>', '<div class="replies">x</div>', '<div class="related">x</div>', '<section class="related-posts"><a>x</a></section>', '<div class="popup">x</div>', '<div class="social">x</div>', '<ins class="adsbygoogle">x</ins>', '<article class="card"><p>x</p></article>', '<article class="comment"><p>x</p></article>', '<footer>x</footer>', '<div id="disqus_thread">x</div>'])
def test_boxes_that_are_not_the_article_s(box):
    assert html_text.blocks(f"<article><h1>T</h1><p>Body.</p>{box}<p>End.</p></article>")[0] == ["T", "Body.", "End."]


@pytest.mark.parametrize("page", ["<div>" * 8000 + "</span>" * 8000, "<a " * 35_000, "<a '" * 30_000, "<b>" * 20_000 + "<br>" * 20_000, "<p>" + "<b>" * 15_000 + "<hr>" * 15_000, "<!x " * 30_000, "<div><article>" * 7000])
def test_long_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 2.5


def test_text_behind_an_open_comment_is_hidden():
    assert html_text.blocks("<article>a<!-- b <i> c</article>")[0] == ["a"] and html_text.blocks("x<!-- y") == ([], ["x"])


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></div>", "<!-- open", "<script>x", "<div class='a>b", "a<b>c" * 3000, "<p " * 500])
def test_broken_pages_do_not_fail(page):
    html_text.blocks(page)


def test_pages_of_the_tables(spark):
    import re

    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {x["page_id"]: x["text"] for x in html_text.op4_html_text(spark, SF).collect()}
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        parts = (" ".join(html_lib.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?p>|<br>|</?h1>", article))
        assert got[row["page_id"]] == " ".join(p for p in parts if p)


@pytest.mark.parametrize("most", [2_000_000, 50])
def test_host_repeats_go_and_unique_runs_stay(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "HOST_TOKENS", most)
    common = " ".join(f"boiler{k}" for k in range(20))
    rows = [(k, "http://h.org/x", f"<div>one start{k} {common} end{k}</div>") for k in range(5)]
    rows += [(9, "http://other.org/", f"<div>alone {common}</div>"), (10, None, None), (11, "http://h.org/", ""), (12, "http://h.org/d", "<p>same page text</p>"), (13, "http://h.org/e", "<p>same page text</p>"), (None, "odd url", "<p>x</p>")]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {x["page_id"]: x["text"] for x in html_text.extract_text(df).collect()}
    assert [got[k] for k in range(5)] == [f"one start{k} end{k}" for k in range(5)]
    assert got[9] == f"alone {common}" and got[10] == got[11] == "" and got[12] == got[13] == "same page text" and got[None] == "x"


def test_repeated_runs_by_brute_force():
    r = rng(8)
    streams = [[r.choice("abc") for _ in range(r.randrange(40))] for _ in range(12)]
    distinct = list(dict.fromkeys(map(tuple, streams)))
    seen = {}
    for n, s in enumerate(distinct):
        for k in range(len(s) - 3):
            seen.setdefault(s[k : k + 4], set()).add(n)
    for stream, left in zip(streams, html_text.unique_runs(streams, 4)):
        gone = {x for k in range(len(stream) - 3) if len(seen[tuple(stream[k : k + 4])]) > 1 for x in range(k, k + 4)}
        assert left == [t for x, t in enumerate(stream) if x not in gone]


# 5: SimHash.


def fingerprint(text, shingle=3):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    parts = [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, ids, reach):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints(spark):
    texts = [*ODD, *odd_texts(9)[len(ODD) :], " ".join("w%d" % (k % 700) for k in range(2000))]
    got = {x["id"]: x["fp"] & (2**64 - 1) for x in simhash.fingerprints(with_clashes(docs_df(spark, texts))).collect()}
    assert got == {k: fingerprint(t) for k, t in enumerate(texts)}


def test_components_of_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    r, fps = rng(10), []
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 12])):
            fps.append(base)
            base ^= (1 << r.randrange(64)) | (1 << r.randrange(64)) if r.random() < 0.7 else 0
    fps += [0] * 30
    ids = r.sample(range(10_000), len(fps))
    rows = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in zip(ids, fps)], "id long, fp long")
    got = {x["id"]: x["component_id"] for x in simhash.near_duplicates(rows).collect()}
    assert got == dict(zip(ids, classes(fps, ids, 2)))


def test_every_near_pair_meets_in_one_leaf():
    r = np.random.default_rng(11)
    fps = np.unique(r.integers(0, 2**64, 3000, dtype=np.uint64))
    near = np.unique(np.r_[fps, fps[:500] ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64))])
    tree = simhash.fit_tree(fps[:1000], 32)
    leaves = {}
    home = np.full(len(near), -1)
    for leaf, homes, visitors in tree.route(near, 2):
        assert (home[homes] == -1).all()
        home[homes] = leaf
        leaves[leaf] = {*homes.tolist(), *visitors.tolist()}
    assert (home >= 0).all() and tree.leaves > 8
    for i in range(len(near)):
        for j in np.flatnonzero(np.bitwise_count(near ^ near[i]) <= 2):
            assert j in leaves[home[i]] or i in leaves[home[j]]


def similarities(texts, shingle=5):
    """The Jaccard similarities of texts that share shingles."""
    sets, at = {}, {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({" ".join(w)} if w else set())
        for x in sets[i]:
            at.setdefault(x, []).append(i)
    out = {i: {} for i in texts}
    for own in at.values():
        for i in own:
            for k in own:
                if i != k and k not in out[i]:
                    out[i][k] = len(sets[i] & sets[k]) / len(sets[i] | sets[k])
    return out


def test_similar_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 32)
    r, rows, of = rng(14), [], {}
    for k in range(80):
        base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(250)]
        for n in range(1 + (k % 4 == 0) * 3):
            copy = list(base)
            for _ in range(n and r.choice([1, 2, 3])):
                copy[r.randrange(250)] = "changed"
            of[len(rows)] = k
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "same"), (901, "same"), (902, None), (903, ""), (None, "same")]
    got = {x["id"]: x["component_id"] for x in simhash.similar_groups(with_clashes(spark.createDataFrame(rows, DOCS))).collect()}
    first = {}
    for i, k in of.items():
        first.setdefault(k, i)
    assert got == {i: first[k] for i, k in of.items()} | {900: 900, 901: 900, 902: 902, 903: 902}
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, DOCS))
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted([*first.values(), 900, 902])
    assert kept.filter("doc_id IS NULL").count() == 1


def groups_by_brute_force(rows, similarity=0.8, shingle=5):
    """The smallest reachable position of each row, by the exact similarity of distinct shingles."""
    words = [t.split() for t in rows]
    sets = [{tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} for w in words]
    first = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if len(sets[i] & sets[k]) * 10 >= similarity * 10 * len(sets[i] | sets[k]) and first[i] != first[k]:
                low, high = sorted((first[i], first[k]))
                first = [low if f == high else f for f in first]
    return first


def test_similar_groups_at_the_bound(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    r, rows = rng(21), []
    for k in range(120):  # cutting n of 104 words' ends gives a similarity of (100 - n) / 100 on either side of 0.8
        base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(104)]
        rows += [" ".join(base), " ".join(base[r.choice([18, 20, 20, 21, 24, 30]) :])]
    for k in range(20):  # chains of which only neighbours are similar, and sets of 5 and 4 shingles
        base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
        rows += [" ".join(base[n : n + 104]) for n in (0, 22, 11, 33)]
        rows += [" ".join(base[:9]), " ".join(base[:8]), " ".join(base[:7])]
    expected = groups_by_brute_force(rows)
    assert 40 < sum(a != b for a, b in zip(expected, range(len(rows)))) < len(rows) - 80
    got = {x["id"]: x["component_id"] for x in simhash.similar_groups(docs_df(spark, rows)).collect()}
    wrong = [k for k, x in enumerate(expected) if got[k] != x]
    assert all(got[k] == k for k in wrong) and len(wrong) <= 2  # nothing is linked below the bound; recall is 0.99


def test_sketches_bound_what_sets_do_not_share():
    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 63, 6000).astype(np.uint64)
    sets = [np.unique(np.r_[base[: n - n // k], r.integers(0, 1 << 63, n // k).astype(np.uint64)]) for n in (1, 3, 15, 16, 17, 200, 230, 1000, 1200, 5000) for k in (3, 10, 40)]
    sets += [base[:0], np.unique(base)]
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    got = simhash.Sketches([simhash.sketch_of(s) for s in sets]).least_apart(i, j)
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (got <= apart).all() and (got[i == j] == 0).all()
    close = np.array([max(len(sets[a]), len(sets[b])) in range(100, 900) for a, b in zip(i, j)]) & (apart < 120)
    assert close.any() and (got[close] >= 0.8 * apart[close]).all()


def test_pairs_just_below_the_bound_are_not_proposed_again_and_again(spark, monkeypatch):
    r, proposed = rng(31), []
    words = lambda n: ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    base = words(170)
    rows = [base + words(34) for _ in range(60)]  # similarity 0.71 with one another
    rows += [[*x[:203], "changed"] for x in rows[:10]]  # 0.99 with one
    rows += [base + rows[20][170:187] + words(17), base + rows[20][170:197] + words(7)]  # 0.80 and more with one, and with each other
    rows = [" ".join(x) for x in rows]

    def written(df, tag, write=simhash.materialise):
        out = write(df, tag)
        if tag == "proposed":
            proposed.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", written)
    got = {x["id"]: x["component_id"] for x in simhash.similar_groups(docs_df(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == groups_by_brute_force(rows)
    assert len(set(got.values())) == 60 and sum(proposed) <= 2 * len(rows)  # of 2,556 pairs


def test_a_repeated_line_does_not_make_texts_similar(spark):
    r = rng(22)
    line = " ".join(f"l{k}" for k in range(20))
    rows = [" ".join([line] * 20 + ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(500)]) for _ in range(12)]
    got = simhash.similar_groups(docs_df(spark, rows)).collect()
    assert len(got) == 12 and all(x["id"] == x["component_id"] for x in got)


def test_simhash_dedup_keeps_another_text_of_a_removed_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (2, f"{a} more"), (2, b), (None, a), (3, "x y z")]
    out = simhash.simhash_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((x["doc_id"], x["text"]) for x in out), key=str) == sorted([(1, a), (2, b), (None, a), (3, "x y z")], key=str)


def test_a_large_group_of_near_copies_gives_few_links():
    r = np.random.default_rng(15)
    n = 3000
    checks = np.full((n, 2), 7, np.uint64) ^ (np.uint64(1) << r.integers(0, 64, (n, 2), dtype=np.uint64))
    a, b = simhash.similar_links(np.full(n, 5, np.uint64), checks, np.arange(n), np.ones(n, bool), 18, 20)
    assert len(a) == n - 1 and set(b.tolist()) == {0}


@pytest.mark.parametrize("n_groups", [1, 7, 400])
def test_proposed_pairs_by_brute_force(n_groups):
    r = np.random.default_rng(n_groups)
    n, bits, most = 400, 9, 6
    keys = np.r_[r.integers(0, 1 << bits, n - 120), np.full(120, 77)].astype(np.uint64)
    checks = r.integers(0, 1 << 4, (n, 2)).astype(np.uint64)
    groups = r.permutation(n) % n_groups if n_groups < n else np.arange(n)
    got = [(int(i), int(j)) for a, b, _ in simhash._proposed(keys, checks, groups, 300, bits, most) for i, j in zip(a, b)]
    expected = {(i, j) for i in range(300) for j in range(n) if groups[i] != groups[j] and (int(keys[i]) ^ int(keys[j])).bit_count() <= 1 and sum((int(x) ^ int(y)).bit_count() for x, y in zip(checks[i], checks[j])) <= most}
    assert len(got) == len(set(got)) and set(got) == expected


def test_keys_grow_with_the_table_and_miss_as_few():
    plans = [simhash.key_plan(n, 0.8) for n in (0, 1000, 1 << 20, 1 << 24, 1 << 36)]
    assert plans[0] == plans[1] and [b for b, _ in plans[1:]] == [18, 18, 22, 34]
    p = simhash.most_bits(0.8, 1 << 20) / (1 << 20)
    assert all((1 - (1 - p) ** b - b * p * (1 - p) ** (b - 1)) ** t <= simhash.MISSED for b, t in plans)


def test_links_of_a_leaf_that_is_dealt_again(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 32)
    r = np.random.default_rng(16)
    base = r.integers(0, 2**64, 500, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64))
    every = np.unique(np.r_[base, near])
    a, b = simhash.leaf_links(every[:600], every[600:], 2)
    label = {x: x for x in every.tolist()}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 2 or find(x) == find(y) or label.update({max(find(x), find(y)): min(find(x), find(y))}) is None
        label[max(find(x), find(y))] = min(find(x), find(y))
    got = [find(x) for x in every.tolist()]
    expected = classes(every.tolist(), every.tolist(), 2)
    visitors = set(every[600:].tolist())
    for x, g, e in zip(every.tolist(), got, expected):
        assert g == e or x in visitors or e in visitors


def test_many_splitters(spark):
    r = rng(31)
    keys = [r.randrange(1 << sharding.KEY_BITS) >> r.choice([0, 0, 30]) for _ in range(40_000)]
    rows = spark.createDataFrame([(k, 1) for k in keys], "key long, size long")
    cuts = sharding.splitters(rows, 3000, tolerance=0.05)
    sizes = np.diff([0, *np.searchsorted(np.sort(keys), cuts).tolist(), len(keys)])
    assert len(cuts) == 2999 and sizes.max() <= 16 and sizes.sum() == len(keys)


def test_hot_rows_keep_their_columns_whatever_their_names(spark):
    rows = spark.createDataFrame([(1, "a", 5, 6, 7, 8, 9), (2, "b", 1, 2, 3, 4, 5), (2, "b", 1, 2, 3, 4, 5)], "doc_id long, text string, _key int, _part int, _nth int, row int, start int")
    out = sharding.shard(rows, 2)
    assert out.columns == [*rows.columns, "size", "shard", "slot"] and sorted(x["_key"] for x in out.collect()) == [1, 1, 5]
    out = exact_dedup.exact_dedup(rows)
    assert out.columns == rows.columns and sorted((x["_nth"], x["row"]) for x in out.collect()) == [(3, 4), (7, 8)]


@pytest.mark.parametrize("broadcast", [100_000, 10])
def test_components_of_nothing_and_of_a_hub(spark, monkeypatch, broadcast):
    monkeypatch.setattr(_shared, "BROADCAST_EDGES", broadcast)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges = spark.range(1, 20_000).selectExpr("id AS a", "0L AS b")
    assert components(edges).selectExpr("count(*)", "max(root)").first() == (20_000, 0)


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1200)}


# 6: WARC.


PAGES = [(-7, "neg", "below"), (-(1 << 63), "least", "below"), (3, "other", "of another id"), (21, "o", "of another id"), (5, "http://a/5", "same"), (3, "http://a/3\n x", "same"), (9, None, ""), (1, "u", ""), (7, "u7", "é" * 10), (None, "n", "same"), (3, "dup", "same"), (11, "z", None), (12, "q", "x\r\n\r\n" * 40_000), (13, "w", "WARC/1.1\r\n\r\n")]


def test_warc_round_trip(spark, tmp_path):
    df = with_clashes(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    runs = []
    for k in range(2):
        folder = str(tmp_path / f"w{k}")
        files = warc.write_warc(df, folder, roll_bytes=300, shard_bytes=100).collect()
        assert len(files) > 4 and not (tmp_path / f"w{k}" / "_under_way").exists()
        runs.append({f["name"]: (tmp_path / f"w{k}" / f["name"]).read_bytes() for f in files})
    assert runs[0] == runs[1]
    got = warc.read_warc(spark, str(tmp_path / "w0")).collect()
    first = {"same": 3, "": 1, "below": -(1 << 63), "of another id": 3}
    expected = []
    for i, u, h in PAGES:
        payload = h or ""
        refers = first.get(payload) if first.get(payload) != i else None
        expected.append(("revisit" if refers is not None else "response", i, " ".join((u or "").split()), len(payload.encode()), base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode(), refers, None if refers is not None else payload))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_warc_of_many_shards(spark, tmp_path):
    rows = spark.range(2400).selectExpr("id * 977 - 1200000 AS page_id", "concat('http://h/', id) AS url", "concat('page ', id % 2000) AS html")
    files = warc.write_warc(rows, str(tmp_path / "w"), shard_bytes=18)
    assert files.count() > 1000
    got = warc.read_warc(spark, str(tmp_path / "w"))
    assert got.filter("record_type = 'revisit'").count() == 400
    both = got.join(rows.select("page_id", "html"), "page_id").selectExpr("count(*) AS n", "sum(int(payload_bytes = length(html))) AS same").first()
    assert (both["n"], both["same"]) == (2400, 2400)


def test_warc_least_bytes_and_damage(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    files = warc.write_warc(df, str(tmp_path / "w"), least_bytes=1).collect()
    assert {x["page_id"] for x in warc.read_warc(spark, str(tmp_path / "w")).filter("record_type = 'revisit'").collect()} == {-7, 5, 21, None}
    path = tmp_path / "w" / files[0]["name"]
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="the file ends within a record|checksum|decompress|records"):
        warc.read_warc(spark, str(tmp_path / "w")).collect()


# 7: substring dedup.


def deduped_by_brute_force(docs: list[tuple[int, str | None]], window: int = 13) -> list[tuple[int, int, int, str]]:
    """The same rows from a dictionary of all windows; for tests."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, words in split:
        gone = {x for k in range(len(words) - window + 1) if least[tuple(words[k : k + window])] < i for x in range(k, k + window)}
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(w for x, w in enumerate(words) if x not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup(spark, window):
    r = rng(12)
    texts = [" ".join(r.choice(["a", "bb", "c", "dd", "é"]) for _ in range(r.randrange(60))) for _ in range(80)]
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [f"x{k} {passage} y{k}" for k in range(6)] + [passage, passage, f"\n{passage}\t \x0b", *ODD, "z " * 500, "z " * 500]
    rows = [(k, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    rows += [(3, passage), (3, passage), (200, texts[80])]
    out = substring_dedup.substring_dedup(with_clashes(spark.createDataFrame(rows, DOCS)), window=window).collect()
    got = [(x["doc_id"], x["n_words"], x["n_removed"], hashlib.sha256(x["text"].encode()).hexdigest()) for x in out]
    assert sorted(got) == sorted(deduped_by_brute_force(rows, window))


def test_substring_dedup_leaves_null_ids(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    out = substring_dedup.substring_dedup(spark.createDataFrame([(None, passage), (2, passage), (None, passage)], DOCS)).collect()
    assert {(x["doc_id"], x["n_removed"]) for x in out} == {(None, 0), (2, 0)} and len(out) == 3


def test_words_of_whole_batches():
    texts = ODD + ["a" * (1 << 20) + "b c", "tail"]
    data, offsets = utf8(pa.array(texts))
    words = words_of(data, offsets)
    buffer = data.tobytes()
    found = [[buffer[a:b] for a, b in zip(words.starts[i:j], words.ends[i:j])] for i, j in zip(words.first, words.first[1:])]
    assert found == [(t or "").encode().split() for t in texts]
    of = {}
    for h, a, b in zip(words.hashes.tolist(), words.starts, words.ends):
        assert of.setdefault(buffer[a:b], h) == h
    assert len(set(of.values())) == len(of)


def thue_morse(n):
    """A word of n letters and its complement, which polynomials modulo a power of two hash alike."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_distinct_words_by_their_bytes():
    r = rng(17)
    texts = [*thue_morse(1024), *thue_morse(2048), *(r.choice("ab") * r.randrange(1, 40) + r.choice(["", "x"]) for _ in range(300)), "a" * 20 + "b" + "a" * 20, "a" * 20 + "c" + "a" * 20]
    data, offsets = utf8(pa.array([" ".join(texts)]))
    words = words_of(data, offsets)
    assert len(set(words.hashes.tolist())) == len(set(texts))
    for hashes in (None, np.zeros(len(texts), np.uint64), words.hashes % np.uint64(5)):
        one, which = distinct(data, words.starts, words.ends, hashes)
        assert [texts[k] for k in one[which]] == texts and len(one) == len(set(texts))


def test_ids_and_counts_of_words_that_look_alike(spark, tokenizer):
    texts = [" ".join(thue_morse(1024)), " ".join(thue_morse(4096)[::-1]) + ", " + thue_morse(1024)[1]]
    pieces = packing.pack(docs_df(spark, texts)).orderBy("doc_id", "start").collect()
    for k, text in enumerate(texts):
        assert [x for p in pieces if p["doc_id"] == k for x in p["ids"]] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    counts = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(docs_df(spark, texts)).collect()}
    assert counts == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    a, b = thue_morse(1024)
    at, which, _ = toxicity.Vocabulary().number(pa.array([f"{a} {b} {a}"]))
    assert len(at) == 2 and which.tolist() in ([0, 1, 0], [1, 0, 1])
    out = substring_dedup.substring_dedup(docs_df(spark, [f"{a} {a} {b}", f"{b} {b} {a}", f"{b} {b} {a}"]), window=3).collect()
    assert {x["doc_id"]: x["n_removed"] for x in out} == {0: 0, 1: 0, 2: 3}


# 8: toxicity.


def test_toxicity_on_held_out_rows(spark):
    out = {x["doc_id"]: x for x in toxicity.op8_toxicity(spark, SF_LARGER).collect()}
    labels = pq.read_table(f"{SF_LARGER}/labels.parquet").to_pylist()
    held = [x for x in labels if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert all(out[x["doc_id"]]["held_out"] for x in held)
    scores = np.array([out[x["doc_id"]]["score"] for x in held])
    toxic = np.array([x["toxic"] for x in held]) == 1
    auc = (scores[toxic][:, None] > scores[~toxic][None]).mean()
    assert auc > 0.9 and ((scores >= 0.5) == toxic).mean() > 0.85
    assert all(x["predicted"] == int(x["score"] >= 0.5) and 0 <= x["score"] <= 1 for x in out.values())


def test_toxicity_without_labels_and_with_odd_texts(spark):
    df = with_clashes(docs_df(spark, ODD))
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] < 0.5 for x in toxicity.score(df, none).collect()} == {True}
    nulls = toxicity.fit(df, spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, toxic int"))
    scored = toxicity.score(df, nulls)
    assert scored.count() == len(ODD) and scored.filter("score IS NULL").count() == 0


def looked_up(texts):
    return toxicity.Vocabulary().look_up(pa.array(texts, pa.string()))


def naive_logit(model, text):
    """The score of one text, word by word."""
    places, at = [], 0
    for width in toxicity.WIDTHS:
        places.append((at, width))
        at += width
    vectors = [sum(model.embeddings[f] for f in toxicity._features(w)[:4]) for w in (text or "").encode().split()]
    out = float(model.out[-1])
    for w, (at, width) in enumerate(places):
        for f in range(toxicity.FILTERS):
            found = [sum(float(vectors[k + s] @ model.filters[at + s][:, f]) for s in range(width) if k + s < len(vectors)) + float(model.bias[w, f]) for k in range(len(vectors))]
            out += max([0.0, *found]) * float(model.out[w * toxicity.FILTERS + f])
    return out


def test_the_forward_pass_by_brute_force():
    model = toxicity.Model.fresh(3)
    model.embeddings *= 20
    texts = ["one two three four", "", None, "word", "a b", " ".join(f"w{k % 9}" for k in range(60))]
    z, _ = model.logits(pa.array(texts, pa.string()), toxicity.Vocabulary())
    assert np.allclose(z, [naive_logit(model, t) for t in texts], atol=1e-3)


def test_gradients_by_differences():
    model = toxicity.Model.fresh(4)
    model.embeddings *= 20
    for name in ("embeddings", "filters", "bias", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    found = looked_up(["one two three", "four", "five six one two seven", ""])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.5, 0.25, 1, 0.3])
    g = toxicity.gradients(model, found[0][:, :4], found[1], found[2], y, weight)

    def loss():
        p = toxicity._sigmoid(model.pooled(*found) @ model.out[:-1] + model.out[-1])
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    def numeric(array, at, step=1e-3):
        held = array[at]
        array[at] = held + step
        up = loss()
        array[at] = held - step
        down = loss()
        array[at] = held
        return (up - down) / (2 * step)

    r = rng(41)
    for array, grads in ((model.out, g.out), (model.bias, g.bias), (model.filters, g.filters)):
        for at in r.sample(list(np.ndindex(array.shape)), 12):
            assert abs(numeric(array, at) - grads[at]) < 2e-3
    for n in r.sample(np.flatnonzero(g.touched).tolist(), 8):
        at = r.randrange(toxicity.DIMENSIONS)
        assert abs(numeric(model.embeddings, (g.touched[n], at)) - g.embeddings[n, at]) < 2e-3


def test_the_sample_passes_over_long_texts(spark):
    df = docs_df(spark, ["bad " * 30, "bad words", "good " * 30, "good words", "bad thing", "good thing"] * 20)
    labels = spark.createDataFrame([(k, int(k % 6 in (0, 1, 4))) for k in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, longest=20)
    got = {x["text"]: x["score"] for x in toxicity.score(df, model).collect()}
    assert got["bad words"] > 0.5 > got["good words"] and got["bad " * 30] > 0.5 > got["good " * 30]


def test_every_labelled_row_trains_long_ones_too(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 40)
    rows = [(k, ("vile " if k % 3 == 0 else "fine ") + "word " * (42_000 if k % 3 == 0 else 20)) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    got = {x["text"][:4]: x["score"] for x in toxicity.score(docs_df(spark, ["vile word", "fine word"]), toxicity.fit(spark.createDataFrame(rows, DOCS), labels)).collect()}
    assert got["vile"] > 0.5 > got["fine"]


def test_shards_learn_what_the_first_has_not_seen(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    monkeypatch.setattr(toxicity, "STEPS", 100)
    ids = spark.range(1000).select("id", toxicity.held_out("id").alias("h"))
    shards = -(-ids.filter("not h").count() // 100)
    shard = {x["id"]: x["s"] for x in ids.select("id", F.expr(f"pmod(xxhash64(id, 2), {shards})").alias("s")).collect()}
    rows = [(k, f"w{k % 7} {('bad' if shard[k] == 0 else 'vile') if k % 4 == 0 else 'good'} w{k % 11}") for k in range(1000)]
    df, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1000)], "doc_id long, toxic int")
    model, again = toxicity.fit(df.coalesce(1), labels), toxicity.fit(df.repartition(7), labels.repartition(3))
    z = model.logits(pa.array(["w1 bad w2", "w1 vile w2", "w1 good w2"]), toxicity.Vocabulary())[0] - model.shift[-1]
    assert shards > 1 and z[0] > 0 and z[1] > 0 > z[2]
    assert all((getattr(model, n) == getattr(again, n)).all() for n in ("embeddings", "filters", "bias", "out", "shift"))


def test_a_score_depends_on_the_text_alone():
    model = toxicity.train(["bad word here", "fine text", "bad again", "all good"] * 30, [1, 0, 1, 0] * 30)
    texts = ["bad thing", "", "good thing", None]
    both = model.scores(pa.array(texts, pa.string()), toxicity.Vocabulary())
    alone = [float(model.scores(pa.array([t], pa.string()), toxicity.Vocabulary())[0]) for t in texts]
    assert np.allclose(both, alone) and both[0] > both[2] and both[1] == both[3]


# 9: decontamination.


def edits_of(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != x)))
        row = now
    return min(row)


def matches_by_brute_force(docs, items):
    """The fewest edits of any passage of an item in a text, where its budget allows them."""
    out = {}
    for i, t in docs:
        for k, text in items:
            own = plain(text)
            if len(own) < 16:
                continue
            n = min(64, len(own))
            fewest = min(edits_of(own[a : a + n], plain(t)) for a in range(len(own) - n + 1))
            if fewest <= min(int(n * 0.1), (n - 8) // 8):
                out[i, k] = fewest
    return out


def plain(text):
    return bytes(c for c in (text or "").lower().encode() if chr(c).isalnum() and c < 128 or c >= 128)


def test_matches_by_brute_force(spark):
    r = rng(13)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randrange(2, 7))) for _ in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([2, 8, 25, 50])))) for k in range(12)] + [(90, "ab"), (91, None), (None, "whatever this is")]
    docs = []
    for k in range(50):
        text = " ".join(r.choice(words) for _ in range(r.randrange(40)))
        if k % 2:
            noisy = list(r.choice(items[:12])[1])
            for _ in range(int(len(noisy) * r.choice([0, 0.03, 0.08, 0.12, 0.2]))):
                at = r.randrange(len(noisy))
                noisy[at] = r.choice(["", "z", noisy[at].upper() + "q"])
            text += ", " + "".join(noisy)[r.choice([0, 0, 20]) :] + "! " + text[::-1]
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, docs[1][1])]
    expected = matches_by_brute_force(docs, [i for i in items if i[0] is not None and i[1] is not None])
    df, bench = with_clashes(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):
        got = decontamination.benchmark_matches(df, bench, block_bytes=block).collect()
        assert {(x["doc_id"], x["item_id"]): x["edits"] for x in got} == expected and len(got) == len(expected)
    kept = decontamination.decontaminate(df, bench, block_bytes=200)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, _ in docs if i not in {d for d, _ in expected})
    assert len(expected) > 10


def test_small_stretches_and_parts_give_the_same_matches(monkeypatch):
    r = rng(33)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 4))) for _ in range(12)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([12, 40, 150])))) for k in range(5)]
    docs = [(k, " ".join(r.choice(words) for _ in range(60)) + " " + items[k % 5][1][r.choice([0, 7, 33]) :][: r.choice([60, 200])]) for k in range(10)]
    expected = matches_by_brute_force(docs, items)
    assert len(expected) >= 5
    for part, pairs, stretch, lanes in ((4096, 1 << 20, 128, 4096), (4096, 64, 4096, 7), (32, 1 << 20, 50, 1), (16, 50, 20, 100), (192, 1, 60, 4096)):
        monkeypatch.setattr(decontamination, "PART", part)
        monkeypatch.setattr(decontamination, "PAIRS", pairs)
        monkeypatch.setattr(decontamination, "STRETCH", stretch)
        monkeypatch.setattr(decontamination, "LANES", lanes)
        found = decontamination.Index(items).matches(pa.array([t for _, t in docs]))
        assert {(docs[t][0], i): e for t, i, e in found} == expected


@pytest.mark.parametrize("text", ["ha" * 50_000, ("ha" * 15 + "x") * 3200, "the same words again and again " * 1500])
def test_repetitive_texts_take_little_work(text):
    index = decontamination.Index([(1, "ha" * 50_000), (2, "some other text that is nowhere else, of a passage's length at least, I think"), (3, "the same words again, and again " * 1000)])
    few = index.matches(pa.array([text[:4000]]))
    pairs, lanes = index.pairs, index.lanes
    assert index.matches(pa.array([text, "ho" * 50_000, "ha" * 20 + "x"])) == few and few
    assert index.pairs - pairs <= 2 * pairs and index.lanes - lanes <= 2 * lanes < 50_000


def test_edits_of_many_passages_by_brute_force():
    r = rng(77)
    passages = ["".join(r.choice("abc") for _ in range(r.choice([8, 16, 40, 63, 64]))) for _ in range(60)]
    regions = ["".join(r.choice("abc") for _ in range(r.randrange(1, 150))) + p[r.randrange(3) :] for p in r.sample(passages, 20)]
    which = np.array([r.randrange(20) for _ in passages])
    as_bytes = lambda texts, n: np.array([list(t.ljust(n, "\0").encode()) for t in texts], np.uint8)
    got = decontamination.fewest_edits(as_bytes(passages, 64), np.array([len(p) for p in passages]), as_bytes(regions, 230), which)
    assert got.tolist() == [edits_of(p, regions[k]) for p, k in zip(passages, which)]


def test_items_without_id_and_short_items(spark):
    phrase = "a passage of the benchmark that has no number of its own, yet is text"
    bench = spark.createDataFrame([(None, phrase), (None, "quite another passage of the benchmark without a number at all"), (1, "the answer"), (2, "ab")], "item_id long, text string")
    docs = docs_df(spark, [f"x {phrase} y", "breathe answers", "So, the answer!", "the answer", "bathe answer", "ab", "clean", "xthe answer. The answer"])
    got = sorted((x["doc_id"], x["item_id"] or 0) for x in decontamination.benchmark_matches(docs, bench).collect())
    assert got == [(0, 0), (2, 1), (3, 1), (7, 1)]
    assert sorted(x["doc_id"] for x in decontamination.decontaminate(docs, bench).collect()) == [1, 4, 5, 6]


# All of them over empty tables.


def test_empty_tables(spark):
    docs, pages = spark.createDataFrame([], DOCS), spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        exact_dedup.dedup_groups(docs), exact_dedup.exact_dedup(docs), sharding.shard(docs), packing.pack(docs), html_text.extract_text(pages), simhash.near_duplicates(simhash.fingerprints(docs)),
        simhash.simhash_dedup(docs), substring_dedup.substring_dedup(docs), toxicity.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int")), decontamination.benchmark_matches(docs, bench),
        decontamination.benchmark_matches(docs, spark.createDataFrame([(1, "some benchmark text")], "item_id long, text string")), token_counts.count_tokens(docs),
    ):
        assert out.count() == 0
    some = docs_df(spark, ["kept as it is"])
    assert decontamination.decontaminate(some, bench).count() == 1 and decontamination.benchmark_matches(some, bench).count() == 0


def test_empty_warc(spark, tmp_path):
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).count() == 0
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


# Those that SQL can express.


def test_same_rows_as_duckdb(spark):
    import duckdb

    from murmur.llm import registry

    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert len(registry.oracle_sql()) >= 3
    for name, sql in registry.oracle_sql().items():
        df, found = registry.queries()[name](spark, SF), con.execute(sql)
        at = [[x[0] for x in found.description].index(c) for c in df.columns]
        assert sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str) == sorted(map(tuple, df.collect()), key=str), name


# The pipeline.


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]
    source = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", None, None, None), (10_002, "", "en", "s", 0)], source.schema)
    docs = source.union(extra)
    benchmark = pq.read_table(f"{SF_LARGER}/benchmark.parquet").to_pylist()
    index = decontamination.Index([(b["item_id"], b["text"]) for b in benchmark])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {x["doc_id"]: x for x in docs.collect()}
        out = stage(spark, docs, SF_LARGER)
        if k < 4:
            assert out.columns == source.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {x["doc_id"]: x for x in docs.collect()}
        if k < 4:
            assert all(before[i] == x for i, x in after.items()) and docs.count() == len(after)
        if name == "toxicity":
            wrong = {x["doc_id"] for x in pq.read_table(f"{SF_LARGER}/labels.parquet").to_pylist() if x["toxic"] != (x["doc_id"] not in after)}
            assert len(wrong) < 30 and 0 < len(before) - len(after) < 200
        elif name == "exact_dedup":
            last = {}
            for i, x in before.items():
                last[x["text"] or ""] = max(i, last.get(x["text"] or "", i))
            assert set(after) == set(last.values())
        elif name == "simhash":
            near = similarities({i: x["text"] for i, x in before.items()})
            assert all(any(j >= 0.5 for j in near[i].values()) for i in set(before) - set(after))
            assert all(i in after for i in before if not any(j >= 0.5 for j in near[i].values()))
            assert not any(i in after and k in after for i, ks in near.items() for k, j in ks.items() if j >= 0.92)
        elif name == "decontamination":
            assert set(after) == {i for i, x in before.items() if not index.matches(pa.array([x["text"]], pa.string()))}
            passages = [plain(b["text"]) for b in benchmark]
            assert not any(p in plain(x["text"]) for x in after.values() for p in passages)
        else:
            assert set(after) == set(before)
            rows = docs.collect()
            of = {}
            for x in rows:
                of.setdefault(x["doc_id"], []).append((x["start"], x["length"], x["doc_tokens"]))
            assert all(sum(n for _, n, _ in v) == v[0][2] for v in of.values())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
