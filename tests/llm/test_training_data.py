"""Each operator against a brute-force version, and on the odd cases: nulls, empty
and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from studyloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t ", "a", "É é ǘ 漢字", "▁x  y ", "x" * 5000, "word " * 3000, "The cat sat.\nThe cat sat.\nThe dog!", "# * | < & $ % >", "😀 \x00 　z"]


def documents(spark, texts, start=0):
    rows = [(start + k, t, ["en", "de", None][k % 3], f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    docs = documents(spark, ODD)
    return docs.union(docs.where("doc_id in (4, 9)")).union(spark.createDataFrame([(None, "no id here at all", None, None, None)], SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n, vocab=40):
    return " ".join(f"w{rng.randint(0, vocab)}" for _ in range(n))


# --- pieces


def test_pieces_equal_the_library(spark, odd, none):
    import sentencepiece

    from studyloom.llm.pieces import encode_documents

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    more = ["".join(rng.choice("  aehtinosr▁éß漢\n!#.😀") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = odd.union(documents(spark, more, 100)).withColumn("IDS", F.lit("clash"))
    rows = encode_documents(docs, path).collect()
    assert len(rows) == len(ODD) + 3 + 300
    for r in rows:
        assert r["ids"] == sp.encode(r["text"] or "")
        assert r["decoded"] == sp.decode(r["ids"])
    assert encode_documents(none, path).count() == 0


def test_decode_of_any_ids(spark):
    import sentencepiece

    from studyloom.llm.pieces import decode_pieces

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    lists = [[rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 8))] for _ in range(400)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)] + [(-1, None)], "k int, ids array<int>").withColumn("t", decode_pieces(F.col("ids"), path)).collect()
    assert all(r["t"] == (sp.decode(r["ids"]) if r["ids"] else "") for r in rows)


# --- id files


def test_id_files_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    from studyloom.llm.id_files import pack, read_id_files, unpack, write_id_files

    path = tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(2)
    more = ["".join(rng.choice("  aehTNRsª́éÀ漢\n!#.'sdve😀<|endoftext|>\x85\xa0 ΣİΑ01") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = odd.union(documents(spark, more, 100)).withColumn("start", F.lit("clash"))
    rows = read_id_files(spark, write_id_files(docs, path, n_shards=3)).collect()
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [w[0] for w in want]
    at = 0
    for r, (_, text) in zip(rows, want):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    assert read_id_files(spark, write_id_files(none, path, n_shards=2)).count() == 0
    for _ in range(200):
        a = np.array([rng.choice([0, 5, 255, 256, 70000, 2**24, 2**32 - 1]) for _ in range(rng.randint(0, 30))], np.uint32)
        assert (unpack(*pack(a), len(a)) == a).all()


def test_chunks_of_every_code_point():
    from tokenizers import Tokenizer

    from studyloom.llm.id_files import ChunkEncoder

    path = tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [t for c in map(chr, range(0x3100)) for t in (f"ab{c}cd", f"{c}ab", f"ab {c}")]
    ids, n = ChunkEncoder(path).encode(texts)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# --- statistics, quality rules


def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd, none):
    from studyloom.llm.quality import quality_rules

    rng = random.Random(3)
    clean = [prose(rng, rng.randint(60, 120), 4000) for _ in range(120)]
    junk = [" ".join(f"{w}###" for w in prose(rng, 80, 4000).split()) for _ in range(10)] + [prose(rng, 80, 4000).upper() for _ in range(10)]
    docs = odd.union(documents(spark, clean, 1000)).union(documents(spark, junk, 2000)).withColumn("KEPT", F.lit(1))
    rows = quality_rules(docs).collect()
    assert len(rows) == len(ODD) + 3 + 140
    for r in rows:
        s = r["stats"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == slow_stats(r["text"])
        base = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        assert r["base_failed"] == base and not (base and r["kept"])
        if r["doc_id"] is not None and r["doc_id"] >= 1000:
            assert r["kept"] == (r["doc_id"] < 2000)
    assert quality_rules(none).count() == 0


def test_sketch_quantiles(spark):
    from studyloom.llm.quality import ACCURACY, bin_of, value_of

    values = [0.0, 0.5, 0.123, 3.0, 100.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_of(bin_of(F.col("v"))).alias("w")).collect()
    assert all(abs(r["w"] - r["v"]) <= ACCURACY * r["v"] + 1e-12 for r in rows)


# --- rule ensemble


def test_rule_ensemble(spark, odd, none):
    from studyloom.llm.rules import fit_quality, fit_rules, score_quality

    rng = random.Random(4)
    good = [prose(rng, rng.randint(20, 80), 4000) for _ in range(80)]
    bad = [" ".join(w + "***" for w in prose(rng, 40, 4000).split()) for _ in range(40)] + [prose(rng, 1) * 1 + " again" * 60 for _ in range(40)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < 80), 0) for k in range(160)] + [(5, None, None), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels, F.col("doc_id") % 3 != 1)
    rows = score_quality(docs.withColumn("score", F.lit("clash")), model).where("doc_id % 3 = 1").collect()
    assert sum(r["predicted"] == int(r["doc_id"] < 80) for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in score_quality(odd, model).collect())
    assert score_quality(none, model).count() == 0
    assert fit_rules(np.zeros((0, 10)), np.zeros(0)).rules == ()
    assert fit_quality(docs, labels.where("false"), F.lit(True)).rules == ()


def test_compiled_rules_equal_the_rules(spark, odd):
    from studyloom.llm.rules import fit_rules, holds, score_quality, statistics
    from studyloom.llm.text_stats import add_stats

    rng = random.Random(17)
    docs = odd.union(documents(spark, [prose(rng, rng.randint(5, 90), rng.choice([3, 30, 3000])) + rng.choice(["", " ### $$", " ABC"]) for _ in range(120)], 100))
    made = statistics()
    rows = add_stats(docs).select("doc_id", *[c.cast("double").alias(k) for k, c in made.items()]).collect()
    x = np.array([[r[k] for k in made] for r in rows])
    model = fit_rules(x, (x[:, 0] > np.median(x[:, 0])).astype(float))
    assert model.rules
    total = model.bias + sum(weight * holds(rule, x).astype(float) for rule, weight in model.rules)
    want = sorted((str(r["doc_id"]), round(float(v), 9)) for r, v in zip(rows, 1 / (1 + np.exp(-total))))
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in score_quality(docs, model).collect()) == want


# --- html


def test_main_text():
    from studyloom.llm.html_paths import main_text

    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=/a>menu</a></li></ul></nav><!-- ad --><div class="ad">Buy, now. Really.</div>
    <article><h1>Head &amp; line</h1><p><b>One
       two<br><p>Three &lt;four&gt;, five.</p><aside>side</aside><form><p>form</p></form><div id="comments"><p>Nice.</p></div></article>
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Head & line\nOne two\nThree <four>, five."
    for empty in (None, "", "<p></p>", "<!-- x", "<script>x", "<", "<nav>only</nav>"):
        assert main_text(empty) in ("", "<")
    plain = "<div class=sidebar>a b c</div><div><p>A long text, with marks. And more; yes.</p><p>Ok &amp; so on, with more text.</p></div><div><a>one</a> <a>two</a></div>"
    assert main_text(plain) == "A long text, with marks. And more; yes.\nOk & so on, with more text."


def test_main_text_keeps_the_article():
    from studyloom.llm.html_paths import main_text

    body = "<p>A long text, with marks. And more; yes.</p><p>Ok &amp; so on, with more text.</p>"
    want = "A long text, with marks. And more; yes.\nOk & so on, with more text."
    assert main_text(f"<div>{body}</div><article class=comment><p>Nice one.</p></article>") == want
    assert want in main_text(f"<div>{body}</div><article class=teaser><p>Nice one.</p></article>")
    assert main_text(f"<div class='layout has-sidebar'><article>{body}</article></div>") == want
    assert main_text(f"<div class='page-with-comments'><div>{body}</div></div>") == want
    assert main_text(f"<article>{body}</article><div class=comment-list><article class=comment><p>Nice one.</p></article></div>") == want


def test_path_scores_decide_inside_regions():
    from studyloom.llm import html_paths as H

    text = "<p>" + "This is a long sentence, with words. " * 8 + "</p>"
    page = f"<article><h1 class=post-header>Title</h1><header class=hd>Line</header>{text * 4}<div>Buy now</div><div>Act fast</div><ul><li>First point of a list, told in words.</li><li>Second point of it.</li></ul></article>"
    got = H.main_text(page).split("\n")
    assert got[:2] == ["Title", "Line"] and "Buy now" not in got and "Act fast" not in got and "Second point of it." in got
    for wrapper in ('class="page has-sidebar"', 'class="ad-free"', 'class="menu-open"', 'id="comment-enabled"', 'class="comments"'):
        assert H.main_text(f"<div {wrapper}>{page}</div>").split("\n") == got
    # ratios of each path, worked out from the paths themselves
    every = H.blocks(page)
    found, marked = H.candidates(every)
    assert marked and len(found) == len(every)
    score = H.path_scores(found, True)
    for path in {b.path for b in found}:
        own = [b.text for b in found if b.path == path]
        length, marks = sum(map(len, own)) / len(own), sum(sum(c in ".,;:!?" for c in t) for t in own) / len(own)
        assert score[path] == pytest.approx(length * (1 + marks))
    smooth = H.path_scores(found, False)
    n = len(found)
    for path in {b.path for b in found}:
        total = 0.0
        for i in (i for i in range(n) if found[i].path == path):
            near = [(np.exp(-((i - j) ** 2) / 2), found[j].path) for j in range(max(0, i - 2), min(n, i + 3))]
            mean = lambda f: sum(w * np.mean([f(b.text) for b in found if b.path == q]) for w, q in near) / sum(w for w, _ in near)  # noqa: B023, E731
            total += mean(len) * (1 + mean(lambda t: sum(c in ".,;:!?" for c in t)))
        assert smooth[path] == pytest.approx(total / sum(b.path == path for b in found))


def test_main_text_of_broken_pages_is_linear():
    import time

    from studyloom.llm.html_paths import main_text

    for piece in ('<a "', "<a '<b \">", "<div>x", "</x>", "<![CDATA[", "<b><p>", "<li>", "<!--", "<"):
        began = time.perf_counter()
        main_text(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 20, piece


def test_extract_pages(spark):
    from studyloom.llm.html_paths import extract_pages

    pages = spark.createDataFrame([(1, "u", "<article><p>x</article>", "c"), (2, None, None, "c"), (1, "u", "<article><p>x</article>", "c")], "page_id long, url string, html string, TEXT string")
    assert sorted(r["text"] for r in extract_pages(pages).collect()) == ["", "x", "x"]
    assert extract_pages(pages.where("false")).count() == 0


# --- SimHash


def slow_classes(rows):
    prints = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, p, least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def test_simhash(spark, odd, none, monkeypatch):
    from studyloom.llm import simhash

    rng = random.Random(5)
    base = [prose(rng, 60, 5000) for _ in range(20)]
    near = [" ".join(w if rng.random() > 0.03 else "x" for w in b.split()) for b in base for _ in range(6)]
    docs = odd.union(documents(spark, base + near, 100)).withColumn("FP", F.lit("clash"))
    want = slow_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = simhash.near_duplicates(docs)
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got.collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    monkeypatch.setattr(simhash, "CHUNK", 4)  # dense anchors are cut into chunks
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == want
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert kept == sorted({k[2] for k in want if k[2] is not None})


def test_drop_keeps_one_row_of_each_component(spark, none):
    from studyloom.llm.near_copies import drop_near_copies
    from studyloom.llm.simhash import drop_near_duplicates

    rng = random.Random(15)
    a, b, c, d, e = (prose(rng, 80, 5000) for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (1, c), (7, d), (7, e), (7, e), (8, e), (9, None), (10, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Mark", F.lit("x")).withColumn("spans", F.lit("y"))
    want = sorted([("None", a), ("None", b), ("1", c), ("7", d), ("7", e), ("9", "None")])
    for drop in (drop_near_duplicates, drop_near_copies):
        got = drop(docs)
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == want and got.columns == docs.columns
        assert drop(none).count() == 0


@pytest.mark.parametrize("plan", [0, 1])
def test_links_of_random_prints(spark, plan):
    from studyloom.llm.components import components
    from studyloom.llm.simhash import links

    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(5):
            prints.add(p ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = links(spark.createDataFrame([(p,) for p in signed], "fp long"), plan)
    got = {r["node"]: r["root"] for r in components(found).collect()}
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


# --- near copies


def slow_copies(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = label[i], label[j]
                label = [y if k == x else k for k in label]
    least = {}
    for (d, _), r in zip(rows, label):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, least.get(r)) for (d, _), r in zip(rows, label))


def test_near_copies(spark, odd, none):
    from studyloom.llm.near_copies import drop_near_copies, near_copies

    rng = random.Random(12)
    texts = []
    for k in range(25):  # copies around a similarity of 0.8, each changed on its own
        words = prose(rng, rng.randint(60, 400), 5000).split()
        texts.append(" ".join(words))
        for rate in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(f"x{rng.random()}" if rng.random() < rate else w for w in words))
    docs = odd.union(documents(spark, texts, 100)).withColumn("NODE", F.lit("clash"))
    want = slow_copies([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter((r["doc_id"], r["component_id"]) for r in near_copies(docs).collect()) == want
    kept = sorted(r["doc_id"] for r in drop_near_copies(docs).collect() if r["doc_id"] is not None)
    assert kept == sorted({c for _, c in want if c is not None})
    assert near_copies(none).count() == 0


def test_pipeline_drops_copies_of_similarity_0_8(spark):
    import corpus_pipeline

    rng = random.Random(13)
    words = prose(rng, 200, 5000).split()
    near, far = list(words), list(words)
    for at in (30, 90, 150):  # 15 of 196 shingles differ
        near[at] = "x"
    for at in range(10, 190, 20):  # 45 differ
        far[at] = "y"
    docs = documents(spark, [" ".join(w) for w in (words, near, far)])
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == {0, 2}


# --- decontamination


def slow_hits(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    ids |= wins[g]
        out[d, t] = (len(w), len(hit), sorted(ids))
    return out


def test_decontamination(spark, odd, none):
    from studyloom.llm.decontam import decontaminate, hits

    rng = random.Random(7)
    texts = [prose(rng, 80, 30) for _ in range(30)]
    items = [(k, " ".join(t.split()[5 : 5 + rng.randint(1, 20)])) for k, t in enumerate(texts[:12])] + [(50, "a"), (51, None), (52, "..."), (53, "THE Cat"), (54, "no id here"), (55, "É é")]
    docs = odd.union(documents(spark, texts, 100)).withColumn("mark", F.lit("clash"))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = slow_hits([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["item_ids"])) for r in hits(docs, table).collect()}
    assert got == {d: v for (d, _), v in want.items()}
    kept = Counter(r["doc_id"] for r in decontaminate(docs, table).collect())
    assert kept == Counter(r["doc_id"] for r in docs.collect() if not got[r["doc_id"]][1])
    assert hits(none, table).count() == 0
    assert decontaminate(docs, table.where("false")).count() == docs.count()


def test_decontamination_of_repeated_rows(spark):
    from studyloom.llm.decontam import decontaminate, hits

    rng = random.Random(14)
    text = prose(rng, 40, 5000)
    window = " ".join(text.split()[10:20])
    rows = [(1, text), (1, text), (1, text), (None, text), (None, text), (2, text), (3, "clean " * 20), (3, "clean " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, window), (8, " ".join(text.split()[30:33]))], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["item_ids"])) for r in hits(docs, items).collect())
    assert got == [("1", 40, 13, [7, 8])] * 3 + [("2", 40, 13, [7, 8])] + [("3", 20, 0, [])] * 2 + [("None", 40, 13, [7, 8])] * 2
    assert [r["doc_id"] for r in decontaminate(docs, items).collect()] == [3, 3]


def test_proximity(spark):
    from studyloom.llm.decontam import build_index, find_near, vocabulary

    docs = documents(spark, ["the red big fox ran", "fox and then the red", "red fox", "fox " * 5])
    phrases = spark.createDataFrame([(1, ["red", "fox"])], "phrase int, words array<string>")
    vocab = vocabulary(phrases.select("words"))
    got = {(r["doc_id"], r["start"], r["width"]) for r in find_near(build_index(docs, vocab), vocab, phrases, 1).collect()}
    assert got == {(0, 1, 3), (2, 0, 2)}


# --- secrets


def slow_spans(text):
    from studyloom.llm.secrets import ASSIGN

    out = []
    for kind, (p, group, least) in enumerate(((ASSIGN, 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24))):
        out += [(m.start(), kind, m.end()) for m in re.finditer(p, text or "") if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets(spark, odd, none):
    from studyloom.llm.secrets import find_secrets, redact

    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = "Ab3dEf6hIj9kLm2nOp5qRs8tUv"
    texts = [f"é😀 PassWord: '{hexes(8)}' x token=token:abcdef {hexes(30)}", "AKIA" + "Z" * 16, "xAKIA123 AKIAAKIA" + "Q" * 20, f"api_key = {hexes(24)}", "secret=a secret==abcdef", hexes(23), f"value {mixed} end"]
    texts += [f"doc {k} has {mixed[::-1]} in it" for k in range(8)] + ["password=hunter22 " * 50]
    docs = odd.union(documents(spark, texts, 100)).withColumn("SPANS", F.lit("clash"))
    found = find_secrets(docs)
    rows = found.withColumn("clean", redact(F.col("text"), F.col("spans"))).collect()
    assert len(rows) == len(ODD) + 3 + len(texts)
    for r in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3] == slow_spans(r["text"])
        text, at, want = r["text"] or "", 0, ""
        for s in r["spans"]:
            if s["start"] >= at:
                want += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert (r["clean"] or "") == (want + text[at:] if r["spans"] else text)
    generic = {r["doc_id"] for r in rows if any(s["kind"] == 3 for s in r["spans"])}
    assert generic == {106}  # of one owner; the other value is spread over four
    assert find_secrets(none).count() == 0


def test_texts_with_very_many_secrets(spark):
    from studyloom.llm.secrets import find_secrets, redact

    many = "token=abcdef12 é " * 3000
    docs = documents(spark, [many, "clean"]).withColumn("_mark", F.lit("kept")).withColumn("__x", F.lit(1))
    rows = {r["doc_id"]: r for r in find_secrets(docs).withColumn("clean", redact(F.col("text"), F.col("spans"))).collect()}
    assert [(s["start"], s["end"]) for s in rows[0]["spans"]] == [(17 * k, 17 * k + 14) for k in range(3000)]
    assert rows[0]["clean"] == "[SECRET] é " * 3000 and rows[1]["clean"] == "clean" and rows[0]["_mark"] == "kept"


# --- context-tree weighting


def test_ctw(spark, odd, none):
    from studyloom.llm import ctw

    rng = random.Random(9)
    docs = odd.union(documents(spark, [prose(rng, 30, 12) for _ in range(40)], 100))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = ctw.score_documents(docs.withColumn("block", F.lit("clash")), held).collect()
    all_docs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    count = Counter(w for d, t in all_docs if not out(d) for w in [*ctw.normal(t).split(), b""])
    n, v = sum(count.values()), len(count)
    counts = Counter()  # (context, bits so far, bit)
    for d, t in all_docs:
        if not out(d):
            raw = bytes([255]) * ctw.DEPTH + ctw.normal(t) + b"\xff"
            for i in range(ctw.DEPTH, len(raw)):
                for depth in range(ctw.DEPTH + 1):
                    for j in range(8):
                        counts[raw[i - depth : i], (1 << j) | raw[i] >> (8 - j), raw[i] >> (7 - j) & 1] += 1
    children = {}
    for c, p, _ in counts:
        if c:
            children.setdefault((c[1:], p), set()).add(c)
    own = lambda c, p: float(ctw.log_kt(np.array([float(counts[c, p, 0])]), np.array([float(counts[c, p, 1])]))[0])
    below, memo = {}, {}

    def total(c, p):
        if (c, p) not in memo:
            x = own(c, p)
            if len(c) < ctw.DEPTH:
                below[c, p] = sum(total(k, p) for k in children.get((c, p), ()))
                x = np.logaddexp(x, below[c, p]) - np.log(2)
            memo[c, p] = x
        return memo[c, p]

    def predict(c, p, bit, full):
        a, b = counts[c, p, 0], counts[c, p, 1]
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        if len(c) == ctw.DEPTH:
            return kt
        longer = full[len(full) - len(c) - 1 :]
        if counts[longer, p, 0] + counts[longer, p, 1] == 0:
            return kt
        total(c, p)
        w = 1 / (1 + np.exp(below[c, p] - own(c, p)))
        return w * kt + (1 - w) * predict(longer, p, bit, full)

    texts = {}
    for d, t in all_docs:
        texts.setdefault(d, t)
    checked = 0
    for r in rows:
        raw = ctw.normal(texts[r["doc_id"]])
        words = [*raw.split(), b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        if len(raw) < 300 and checked < 25:
            checked += 1
            padded, score = bytes([255]) * ctw.DEPTH + raw + b"\xff", 0.0
            for i in range(ctw.DEPTH, len(padded)):
                for j in range(8):
                    score += np.log10(predict(b"", (1 << j) | padded[i] >> (8 - j), padded[i] >> (7 - j) & 1, padded[i - ctw.DEPTH : i]))
            assert r["score"] == pytest.approx(score)
    assert len(rows) == len(all_docs) and checked == 25
    assert ctw.score_documents(none, F.lit(False)).count() == 0


def test_ctw_long_text_in_little_memory():
    """A text of some pieces takes no more than the pieces do."""
    import tracemalloc

    from studyloom.llm import ctw

    rng = random.Random(31)
    text = " ".join(prose(rng, 20, 50) for _ in range(40)) * 4000
    text = text[: 4 * ctw.PIECE_BYTES]
    tracemalloc.start()
    block = ctw._Block()
    block.add(text, False)
    key, n = ctw._merged(block.runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)
    assert (key == np.unique(ctw.strings_of([ctw.normal(text)]))).all() and n.sum() == len(text) + 1
    assert block.tokens == Counter([*ctw.normal(text).split(), b""])


def test_ctw_pieces(monkeypatch):
    """Texts cut into pieces, and blocks that are given out in parts, have the sums of whole ones."""
    from studyloom.llm import ctw

    rng = random.Random(32)
    texts = ["", " ", "a", "x" * 200, " \n" * 60, *["".join(rng.choice("ab é\t\n") for _ in range(rng.randrange(300))) for _ in range(60)]]
    raws = [ctw.normal(t) for t in texts]

    def counted():
        found, block = {0: Counter(), 1: Counter()}, ctw._Block()
        parts = 0
        for k, t in enumerate(texts):
            block.add(t, k % 3 == 1)
            if full := block.full() or k == len(texts) - 1:
                parts += full
                for r in block.rows(7):
                    for kind, key, n in zip(*(r.column(c).to_pylist() for c in ("kind", "key", "n"))):
                        found[kind][key] += n
        return found, parts

    def scored(found):
        keys = lambda kind: (np.array([*found[kind]]), np.array([*found[kind].values()], float))
        return *ctw.token_sums(raws, ctw._Counts(*keys(1)), 2.0), ctw.text_sums(raws, ctw._Scores(*keys(0)))

    whole, parts = counted()
    assert parts == 1
    sums = scored(whole)
    assert sums[0].tolist() == [len(r.split()) + 1 for r in raws]
    strings = Counter(k for t, r in enumerate(raws) if t % 3 != 1 for k in ctw.strings_of([r]).tolist())
    assert {k: n for k, n in whole[0].items() if n} == strings
    for name, most in (("PIECE_BYTES", 17), ("PIECE_ROWS", 5), ("MOST_STRINGS", 100), ("MOST_TOKENS", 20)):
        monkeypatch.setattr(ctw, name, most)
    for r in raws:
        assert np.concatenate([*ctw.strings_of_long(r)]).tolist() == ctw.strings_of([r]).tolist()
        assert [w for part in ctw.word_lists(r) for w in part] == [*r.split(), b""]
    cut, parts = counted()
    assert parts > 3 and cut == whole
    for a, b in zip(sums, scored(cut)):
        assert b == pytest.approx(a)


def test_ctw_blocks_of_unlike_texts(spark, monkeypatch):
    """Where texts don't repeat their strings, a block has fewer of them."""
    from studyloom.llm import ctw

    rng = random.Random(33)
    docs = documents(spark, ["".join(rng.choice("0123456789abcdefghijkl ") for _ in range(400)) for _ in range(60)])
    held, blocks = F.col("doc_id") % 5 == 1, []
    plain = {r["doc_id"]: r for r in ctw.score_documents(docs, held).collect()}
    count = ctw.block_counts
    monkeypatch.setattr(ctw, "block_counts", lambda blocked: blocks.append(blocked.select("block").distinct().count()) or count(blocked))
    monkeypatch.setattr(ctw, "MOST_STRINGS", 5000, raising=False)
    cut = {r["doc_id"]: r for r in ctw.score_documents(docs, held).collect()}
    assert blocks[0] == 1 and 3 <= blocks[-1] <= 5
    assert cut.keys() == plain.keys()
    for d, r in cut.items():
        assert r[:6] == plain[d][:6] and r[6:] == pytest.approx(plain[d][6:])


# --- trie counts


def test_trie_counts(spark, odd, none):
    from studyloom.llm.pieces import MARK
    from studyloom.llm.trie_counts import count_tokens, unigram_scores

    path = tokenizer("piece_bpe_32k.model")
    score, byte, longest = unigram_scores(path)

    def slow(word):
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            ways = [(best[end - 1][0] - n * byte, best[end - 1][1] + n)] if word[end - 1] not in score else []
            ways += [(best[k][0] - score[word[k:end]], best[k][1] + 1) for k in range(max(0, end - longest), end) if word[k:end] in score]
            best.append(min(ways))
        return best[-1][1]

    rng = random.Random(10)
    docs = odd.union(documents(spark, ["".join(rng.choice("  aehtinosré漢\n!") for _ in range(40)) for _ in range(100)], 100)).withColumn("N_tokens", F.lit("clash"))
    for r in count_tokens(docs, path).collect():
        text = (MARK + r["text"].replace(" ", MARK)) if r["text"] else ""
        words = re.findall(f"{MARK}+[^{MARK}]*", text)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(map(slow, words)))
    assert count_tokens(none, path).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = prose(rng, 15, 5000)
    base = prose(rng, 200, 5000)
    texts = [base, base, base + " tail", prose(rng, 100, 5000) + " " + item + " " + prose(rng, 20, 5000), prose(rng, 90, 5000) + " password=deadbeef01", "short", None, prose(rng, 120, 5000)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == {0, 4, 7}
    assert rows[0]["text"] == texts[0] and rows[7]["text"] == texts[7]
    assert rows[4]["text"] == texts[4].replace("password=deadbeef01", "[SECRET]") and rows[4]["n_chars"] == len(rows[4]["text"])
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows.values())


def test_stages_of_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a window of a benchmark item that nobody has")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.union(documents(spark, [prose(random.Random(16), 120, 5000) + " password=hunter22"], 300))
    for name in ("stats", "kept", "failed", "base_failed", "spans", "MARK"):
        docs = docs.withColumn(name, F.lit("own"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        assert all(r[c] == "own" for r in rows for c in ("stats", "kept", "failed", "base_failed", "spans", "MARK")), name
        assert {r["doc_id"] for r in rows} >= {300}, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns, name
        empty = stage(spark, none, str(tmp_path))
        assert empty.count() == 0, name


def test_registered_queries_answer(spark):
    from studyloom.llm.queries import oracle_sql, queries

    made = queries()
    assert {re.match(r"op(\d+)_", k).group(1) for k in made if k != "pipeline"} == {str(k) for k in range(1, 14)} and "pipeline" in made
    assert set(oracle_sql()) <= set(made)
    row = made["op6_pieces"](spark, "/root/testdata/sf0.001").first()
    assert len(row["ids_sha256"]) == len(hashlib.sha256(b"").hexdigest())
