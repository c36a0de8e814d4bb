"""Conversation repair, removal of repeated passages and ranked search against
brute-force versions, and on the odd cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.llm import ranked, repeats, turns

CONVERSATION = "conv_id long, turn long, role string, text string"
DOCUMENT = "doc_id long, text string, lang string"


# --- conversations


def cheapest(symbols):
    """(cost, labels) of the best edits: every string of labels is tried, but those that
    end where a better one has ended too."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    todo = [((0, ""), 0, 0)]
    while todo:
        w, at, state = todo.pop()
        if best.get((at, state), (10**9, "")) <= w:
            continue
        best[at, state] = w
        moves = [("I", 5, at, x) for x in "ua"]
        if at < len(symbols):
            s = symbols[at]
            moves.append(("D", 2, at + 1, None))
            if s not in turns.BAD:
                more = 5 if s in turns.CUT else 0
                own = turns.SOUND[(turns.CUT if more else turns.SOUND).index(s)]
                moves += [("R", 1 + more, at + 1, x) for x in "ua"] + [("K", more, at + 1, own)]
        for label, cost, to, x in moves:
            new = state if x is None else turns.GRAMMAR.get((state, x))
            if new is not None:
                todo.append(((w[0] + cost, w[1] + label), to, new))
    return min(best[len(symbols), q] for q in turns.FINAL if (len(symbols), q) in best)


def test_shortest_path_against_search():
    rng = random.Random(0)
    alphabet = turns.SOUND + turns.BAD + turns.CUT
    every = [*map("".join, itertools.product("suaxSU13", repeat=2)), *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(300))]
    for symbols in every:
        cost, labels, done = turns.shortest_path(symbols)
        assert (cost, labels) == cheapest(symbols), symbols
        assert len(done) == len(symbols) + 1 and sum(map(len, done)) == len(labels)


def brute_conversation(rows):
    """Verdict and digest of damaged rows (turn, role, text), by the contract's text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(f"={0}:{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, symbols, counts = set(), "", Counter()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        place = "sua".find(role[:1]) if role else 3
        symbols += {"": turns.SOUND, "truncated": turns.CUT}.get(fault, turns.BAD)[place if place >= 0 else 3]
    given = [t for t, _, _ in rows if t is not None]
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = cheapest(symbols)
    lines, left = [], list(rows)
    for label in audit:
        row = None if label == "I" else left.pop(0)
        if label != "D":
            need = "assistant" if len([x for x in lines if not x.startswith("\0")]) % 2 else "user"
            if label == "K" and row[1][:1] == "s":
                lines.append("\0" + f"{row[1]}:{row[2]}")
                continue
            lines.append(f"{row[1] if label == 'K' else need}:{row[2] if row else ''}")
    text = "\n".join(x.removeprefix("\0") for x in lines)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def verdicts(rows):
    found, repaired = turns.repair(rows)
    sums = {r["conv_id"]: r["sha256"] for r in turns.digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sums.get(r["conv_id"], empty)) for r in found.collect()}


def test_repair_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["One.", "Two!", "cut", "", " \n", "Why?", "É é.", "x" * 40 + "a.", "x" * 40 + "b."]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(texts)))
    made = spark.createDataFrame(rows, CONVERSATION).repartition(5)
    got = verdicts(made)
    assert len(got) == 60
    for conv in range(60):
        own = [r[1:] for r in rows if r[0] == conv]
        ties = Counter((r[0], r[1], r[2][:32]) for r in own)
        if all(n == 1 or len({r[2] for r in own if (r[0], r[1], r[2][:32]) == k}) == 1 for k, n in ties.items()):
            assert got[conv] == brute_conversation(own), own


def test_damage(spark):
    rows = [(c, t, "system" if t == 0 else None if t == 5 else "user", f"Text {t}. And!" if t != 4 else None) for c in (3, None, 8) for t in (*range(40), None)]
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.damaged(spark.createDataFrame(rows, CONVERSATION).withColumn("KIND", F.lit("clash"))).collect())
    want = Counter()
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            want[c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text] += 1 + (k == 3)
    assert got == want


def test_repair_of_odd_conversations(spark):
    rows = [
        (None, 0, "user", "No id."), (None, 1, "assistant", "Here."), (1, 0, None, None), (1, None, "user", "Null first."), (1, 1, "assistant", "Then."),
        *[(2, None, "user", "Same.")] * 3, (3, 0, "system", "Alone."), (4, 0, "user", "word " * 30_000 + "."), (4, 1, "assistant", "Yes."),
    ]
    got = verdicts(spark.createDataFrame(rows, CONVERSATION).withColumn("symbol", F.lit(1)).withColumn("again", F.lit(2)))
    assert got[None][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert got[1][:7] == (0, 1, 0, 0, 2, 2, "KDK") and got[2][:7] == (0, 0, 2, 0, 2, 6, "DDD") and got[3][6] == "D" and got[4][6] == "KK"
    assert got[None][7] == hashlib.sha256(b"user:No id.\nassistant:Here.").hexdigest()
    none, repaired = turns.repair(spark.createDataFrame([], CONVERSATION))
    assert none.count() == 0 and turns.digests(repaired).count() == 0 and turns.damaged(spark.createDataFrame([], CONVERSATION)).count() == 0


def test_a_long_conversation_is_cut_into_blocks(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t != 501 else "") for t in range(1000)]
    got = verdicts(spark.createDataFrame(rows, CONVERSATION).repartition(7))
    whole = turns.shortest_path("".join("ua"[t % 2] if t != 501 else "A" for t in range(1000)))
    assert got[7][5:7] == whole[:2] and got[7][1] == 1
    kept = [f"{r[2]}:{r[3]}" for r, label in zip(rows, whole[1]) if label == "K"]
    assert len(kept) == 998 and got[7][7] == hashlib.sha256("\n".join(kept).encode()).hexdigest()


# --- repeated passages


def brute_repeats(docs, size):
    """(words, removed places) of each row, by the contract's text."""
    key = lambda d: 2**63 - 1 if d is None else d
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            least[g] = min(least.get(g, 2**63), key(d))
    return [(d, w, {i + j for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < key(d) for j in range(size)}) for d, w in words]


def held_against_brute(spark, docs, size, batch=None):
    rows = spark.createDataFrame([(d, t, "en") for d, t in docs], DOCUMENT).repartition(3)
    got = Counter((r["row"]["doc_id"], r["row"]["text"], r["n_words"], r["kept"], tuple(tuple(s) for s in r["spans"])) for r in repeats.cut_repeats(rows, size=size).collect())
    want = Counter()
    for (d, t), (_, w, gone) in zip(docs, brute_repeats(docs, size)):
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        want[d, t, len(w), " ".join(x for i, x in enumerate(w) if i not in gone), tuple(tuple(s) for s in spans)] += 1
    assert got == want


def test_repeats_against_brute_force(spark):
    rng = random.Random(2)
    prose = lambda n, v=3: " ".join(f"w{rng.randint(0, v)}" for _ in range(n))
    shared = [prose(12, 50) for _ in range(4)]
    docs = [(k, f"{prose(rng.randint(0, 20), 9)}\n{rng.choice(shared)}\t{prose(rng.randint(0, 9), 9)}  {rng.choice(shared)}") for k in range(60)]
    held_against_brute(spark, docs, 5)
    held_against_brute(spark, [(k, prose(60, 1)) for k in range(20)], 8)  # few words: windows that overlap themselves


def test_repeats_of_odd_documents(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [
        (None, passage), (None, passage), (None, f"x {passage}"), (3, passage), (3, passage), (3, f"y {passage} z"), (5, f"{passage} {passage}"), (9, None), (10, ""), (11, " \n\t "), (12, passage[:200]),
        (2**63 - 1, passage), (-4, "é 漢   " * 40), (6, "é 漢   " * 40), (20, "a" * 200_000), (21, "word " * 300_000), (22, "word " * 60),
    ]
    held_against_brute(spark, docs, 50)
    none = spark.createDataFrame([], DOCUMENT)
    assert repeats.cut_repeats(none).count() == 0 and repeats.drop_repeats(none).columns == ["doc_id", "text", "lang"]
    clash = spark.createDataFrame([(d, t, "en") for d, t in docs], DOCUMENT)
    names = ("doc", "unnamed", "ref", "row", "at", "sums", "__key_hash", "spans", "kept")
    odd = clash.select("*", *[F.lit("own").alias(n) for n in names])
    got = repeats.drop_repeats(odd)
    assert got.columns == odd.columns and all(r[n] == "own" for r in got.collect() for n in names)
    texts = {r["text"] for r in got.where("doc_id = 9 or doc_id = 11 or doc_id = 5").collect()}
    assert texts == {None, " \n\t ", ""}


def test_repeats_in_small_batches_and_pieces(spark, monkeypatch):
    """Cells, batches and pieces bound memory only."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(200)) for _ in range(6)]
    texts += [texts[0][:300] + " " + texts[1][:400], texts[2], texts[2]]
    words, joined = repeats.Words(), []
    for size in (5, 50):
        for most in (7, 64, 1 << 20):
            monkeypatch.setattr(repeats, "pieces", lambda data, most=most, whole=repeats.pieces: whole(data, most) if most != 7 else (p for p in whole(data, 7)))
            joined.append([(np.concatenate([k for _, k, _ in repeats.windows(t.encode(), words, size)]).tolist(), [a for a, _, _ in repeats.windows(t.encode(), words, size)][0]) for t in texts])
            monkeypatch.undo()
        assert joined[-1] == joined[-2] == joined[-3]
    parts = [(d, d, at, k, w) for d, t in enumerate(texts) for at, k, w in repeats.windows(t.encode(), words, 50)]
    one = [b.num_rows for b in repeats._dealt(list(parts), 3)]
    assert sum(one) >= 3
    cell = repeats.pack(np.array([5, 6, 7], np.uint64), np.array([1, 1, 2**40]), np.array([0, 70_000, 3], np.uint64), np.array([1, 1, 9]))
    assert [x.tolist() for x in repeats.unpack(cell)] == [[5, 6, 7], [1, 1, 2**40], [0, 70_000, 3], [1, 1, 9]]


# --- ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k):
    each = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in each), sum(c.total() for _, c in each)
    df = Counter(t for _, c in each for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for d, c in each:
            m = 50 + (50 * c.total() * n_docs) // total if total else 0
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def searched(spark, docs, items, k=50):
    rows = spark.createDataFrame([(d, t, "en") for d, t in docs], DOCUMENT).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return Counter(tuple(r) for r in ranked.search(rows, asked, k).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 7, "SHARD_POSTINGS": 40}, {"BLOCK": 30}, {"VOCABULARY": 3}, {"FALL": 0.95}])
def test_search_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    rng = random.Random(3)
    word = lambda: f"t{min(int(rng.expovariate(0.12)), 60)}"
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(150)]
    items = [(k, " ".join(word() for _ in range(rng.randint(0, 9)))) for k in range(12)]
    assert searched(spark, docs, items, 5) == brute_search(docs, items, 5)
    assert searched(spark, docs, items) == brute_search(docs, items, 50)


def test_search_of_odd_tables(spark):
    docs = [(4, "Ünder ünder  a-b_c"), (4, "Ünder ünder  a-b_c"), (None, "a b c"), (None, None), (1, "a b c"), (0, "a b c"), (7, ""), (8, " .,-\x00\x7f"), (9, "z " * 50_000 + "a"), (10, "É é 漢字 a0"), (11, "q r s"), (12, "A")]
    items = [(1, "a B c"), (1, "c"), (2, None), (3, ""), (4, "nowhere"), (5, "ÜNDER É 漢字"), (None, "z"), (6, "Ünder")]
    assert searched(spark, docs, items, 3) == brute_search(docs, items, 3)
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items)):
        assert searched(spark, d, i) == Counter()
    wide = spark.createDataFrame([(1, "a b", "en")], DOCUMENT).select("*", *[F.lit("own").alias(n) for n in ("n", "terms", "place", "score", "item_id")])
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string").select("*", F.lit("own").alias("doc_id"), F.lit("own").alias("place"))
    assert ranked.search(wide.union(wide.withColumn("text", F.lit("c"))).union(wide.withColumn("text", F.lit("d"))), asked).count() == 1


def test_search_stops_early_and_completes():
    """The shard takes no posting below the level at which the rest can't matter."""
    n = 4000
    rng = np.random.default_rng(0)
    rare, often = rng.choice(n, 80, False), np.arange(n)
    owner = np.r_[rare, often]
    term = np.r_[np.zeros(80, np.int64), np.ones(n, np.int64)]
    order = np.argsort(owner, kind="stable")
    shard = ranked.Shard(np.arange(n), np.full(n, 10), np.bincount(owner, minlength=n), term[order], np.ones(len(owner), np.int64), (n, 10 * n))
    read = []
    real = shard._complete
    shard._complete = lambda some, *a: read.append(len(some)) or real(some, *a)
    at, score = shard.top(np.array([0, 1]), np.array([4000, 1]), 50)
    assert read == [80] and set(at) <= set(rare.tolist()) and len(at) == 50 and at.tolist() == sorted(rare.tolist())[:50] and len(set(score.tolist())) == 1


# --- columns of the input whose names the operators might use


def test_clashing_columns_stay(spark, tmp_path):
    from studyloom.llm import decontam, html_paths, near_copies, pieces, quality, secrets, simhash, trie_counts
    from studyloom.llm.queries import tokenizer

    names = ("_l", "_s", "_counts", "__mark", "__spans", "__key_h", "__key_hash", "stats", "row", "id", "mark", "hash", "verdict", "counts", "found", "of_lang", "repeat_rate_max")
    rng = random.Random(4)
    text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(90)) + " password=hunter22"
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " more", "en", "s", 9), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("own").alias(n) for n in names])
    item = spark.createDataFrame([(1, "nobody has this window of ten words or even one")], "item_id long, text string")
    path = tokenizer("piece_bpe_32k.model")
    made = {
        "quality": quality.quality_rules(docs), "failing": quality.drop_failing(docs), "secrets": secrets.find_secrets(docs), "counts": trie_counts.count_tokens(docs, path), "pieces": pieces.encode_documents(docs, path),
        "near": simhash.drop_near_duplicates(docs), "copies": near_copies.drop_near_copies(docs), "clean": decontam.decontaminate(docs, item), "repeats": repeats.drop_repeats(docs),
        "pages": html_paths.extract_pages(docs.withColumn("html", F.lit("<p>x</p>"))),
    }
    for what, df in made.items():
        got = df.collect()
        kept = [n for n in names if not (what == "quality" and n == "stats")]
        assert got and all(r[n] == "own" for r in got for n in kept), what
    assert sum(r["doc_id"] == 1 for r in made["near"].collect()) == 1


# --- main text of marked pages


@pytest.mark.parametrize(
    ("inside", "stays"),
    [
        ("<ul><li>one</li><li>two</li></ul>", "one\ntwo"), ("<table><tr><td>Berlin</td><td>3.7</td></tr></table>", "Berlin\n3.7"), ("<dl><dt>a</dt><dd>b</dd></dl>", "a\nb"),
        ("<blockquote>Short.</blockquote>", "Short."), ("<pre>x = 1</pre>", "x = 1"), ("<p>Yes.</p>", "Yes."), ("<h2>Part</h2>", "Part"), ("<figure><figcaption>A map</figcaption></figure>", "A map"),
        ("<div>Buy cheap shoes, today only, at our shop.</div>", ""), ("<div><p>Bob: great post, thanks a lot.</p></div>", ""), ("<ul><li><a href='x'>More news here</a></li></ul>", ""), ("<div class='ad'>Buy.</div>", ""),
    ],
)
def test_main_text_of_marked_pages(inside, stays):
    from studyloom.llm.html_paths import main_text

    long = "The committee met on Monday, and after a long debate, in which all members spoke, it agreed on the plan. " * 4
    page = f"<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>{long}</p>{inside}<p>{long}</p></article><footer>us</footer>"
    assert main_text(page) == "\n".join(x for x in ("T", long.strip(), stays, long.strip()) if x)


def test_main_text_against_a_plain_version():
    """Selection of blocks in random articles, worked out from the page's own parts."""
    from studyloom.llm import html_paths as H

    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(("alpha", "beta,", "gamma.", "delta")) for _ in range(n))
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(2, 8)):
            kind = rng.choice(("p", "p", "p", "div", "ul"))
            parts.append((kind, [words(rng.randint(1, 4)) for _ in range(rng.randint(1, 3))] if kind == "ul" else [words(rng.randint(1, 60))]))
        body = "".join(f"<ul>{''.join(f'<li>{x}</li>' for x in t)}</ul>" if k == "ul" else f"<{k}>{t[0]}</{k}>" for k, t in parts)
        marks = lambda x: len(re.findall("[.,]", x))
        mean = {k: (np.mean([len(t[0]) for q, t in parts if q == k]), np.mean([marks(t[0]) for q, t in parts if q == k])) for k in ("p", "div") if any(q == k for q, _ in parts)}
        want = []
        if mean:
            score = {k: x * (1 + y) for k, (x, y) in mean.items()}
            size = {k: sum(len(t[0]) for q, t in parts if q == k) for k in mean}
            level = H.INSIDE * sum(score[k] * size[k] for k in mean) / sum(size.values())
            parts = [(k, t) for k, t in parts if k == "ul" or score[k] >= level]
            own = [mean[k] if k != "ul" else (sum(map(len, t)), sum(map(marks, t))) for k, t in parts]
            near = lambda i: [(math.exp(-((i - j) ** 2) / 2), own[j]) for j in range(max(0, i - 2), min(len(own), i + 3))]
            for i, (k, t) in enumerate(parts):
                x, y = (sum(w * v[n] for w, v in near(i)) / sum(w for w, _ in near(i)) for n in (0, 1))
                if x * (1 + y) >= level if k == "ul" else score[k] >= level:
                    want += t
            # neighbouring lists are elements of their own
            assert H.main_text(f"<article>{body}</article>") == "\n".join(want)
        else:
            assert H.main_text(f"<article>{body}</article>") == "\n".join(x for _, t in parts for x in t)
