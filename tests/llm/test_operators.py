"""Each operator against a plain version of its contract, on odd documents and on none."""

import hashlib
import io
import random
import re
import wave
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from nestql.llm import decontaminate, jaccard, langid, lines, media, mixing, pages, pii, suffixes, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


# -- 1


def test_media(odd, odd_rows, empty):
    got = defaultdict(list)
    for r in media.media_digest(odd).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(odd_rows)
    by_text = defaultdict(set)
    for i, t, *_ in odd_rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        mine = [r for r in got[i] if r["payload_sha256"] == want[2]]
        assert mine and tuple(mine[0])[1:7] == want
        by_text[t or ""].update(r["feature"] for r in mine)
    assert all(len(f) == 1 for f in by_text.values())
    assert media.media_digest(empty).collect() == []
    kept = {r["doc_id"]: bytes(r["media"]) for r in media.media_columns(odd).where("doc_id = 7").collect()}
    assert media.decode_wav(kept[7])[:7] == b"one two"


def test_fingerprint_of_a_tone():
    t = np.arange(media.RATE)
    burst = (np.sin(2 * np.pi * 1000 * t / media.RATE) * 100 * (t % 2000 < 300) + 128).astype(np.uint8)
    codes = media.fingerprint(burst)
    assert len(codes) and np.all(np.diff(codes) >= 0)
    assert abs(int(codes[0] >> 13 & 127) - 1000 * media.UNIT / media.RATE) <= 2


# -- 2


def targets(sizes, weights=mixing.WEIGHTS, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = [n for n in names if n not in done]
        room = total - sum(done.values())
        share = {n: room * weight[n] / sum(weight[m] for m in left) for n in left}
        over = [n for n in left if share[n] > most * sizes[n]]
        if not over:
            return done | share
        done |= {n: float(most * sizes[n]) for n in over}


def test_mix(odd, odd_rows, empty):
    got = [r.asDict() for r in mixing.mix_of_documents(odd).collect()]
    again = [r.asDict() for r in mixing.mix_of_documents(odd.repartition(5)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(odd_rows)
    sizes = defaultdict(int)
    for _, t, _, s in odd_rows:
        sizes[s] += len(words(t))
    want = targets(sizes)
    source = {(i, len(words(t))): s for i, t, _, s in odd_rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[s] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-6) or abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.mix_of_documents(empty).collect() == []


def test_copies_follow_positions(odd):
    mixed = mixing.mix(odd.select("doc_id", "source", "text"))
    want = sorted(p for r in mixed.collect() for p in r["copies"])
    out = mixing.expand(mixed, ["doc_id", "text", "source"])
    assert out.columns == ["doc_id", "text", "source"] and out.count() == len(want)
    assert all(p == sorted(p) for p in (r["copies"] for r in mixed.collect()))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0.05, 5), min_size=2, max_size=5), st.floats(0, 1))
def test_demand_inverts(spark, weights, share):
    from pyspark.sql import functions as F

    knots = [(i / (len(weights) - 1), w) for i, w in enumerate(weights)]
    t = spark.range(1).select(mixing.invert_demand(mixing._schedule(knots), F.lit(share)).alias("t")).first()["t"]
    grid = np.linspace(0, 1, 20001)
    w = np.interp(grid, [k for k, _ in knots], weights)
    area = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))]
    assert np.interp(t, grid, area / area[-1]) == pytest.approx(share, abs=1e-4)


# -- 3


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_tokens(odd, odd_rows, empty, vocabulary):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary)
    got = sorted((tuple(r) for r in tokens.tokens_of_documents(odd, vocabulary).collect()), key=lambda r: r[1])
    assert len(got) == len(odd_rows)
    assert [r[0] for r in got] == sorted((i for i, *_ in odd_rows), key=lambda i: (i is not None, i or 0))
    want, at = defaultdict(list), 0
    for i, t, *_ in odd_rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    for i, start, n, crc in got:
        assert start == at and (n, crc) in want[i]
        at += n
    assert tokens.tokens_of_documents(empty, vocabulary).collect() == []


def test_texts_share_their_pieces(vocabulary):
    from tokenizers import Tokenizer

    r = random.Random(3)
    words = ["".join(r.choice("abcdeilmnorstuwé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts = ["", "\n", ".", "a.", "what?", "what?!", " x", "  x", "who, me?, yes", *(" ".join(r.choices(words, k=40)) + r.choice(["", ".", "\n", "?", " "]) for _ in range(40))]
    texts = [x + y for x in texts for y in ("", r.choice(texts), "\n" + r.choice(texts), "\0" + r.choice(texts))]
    encoder, plain = tokens.Encoder(open(vocabulary, encoding="utf-8").read(), "<u2"), Tokenizer.from_file(vocabulary)
    for part in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder(part)] == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_workers_let_go_of_encoders(spark, odd, vocabulary):
    """What a worker keeps for one stage must not lie beside the next stages' memory."""

    def held(batches):
        import gc

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())])], names=["n"])

    assert tokens.token_ids(odd, vocabulary)[0].count() == odd.count()
    assert [r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()] == [0] * 16


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", ".", ",", "..", "?", ")", "'s", "'", "_", "9", "é", "\t", "中", "²", "<|endoftext|>", "\x01", "-"]), max_size=14).map("".join))
def test_encoder_is_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = test_encoder_is_the_library.__dict__.setdefault("made", [])
    if not both:
        both += [tokens.Encoder(open(path, encoding="utf-8").read(), "<u2", room=50), Tokenizer.from_file(path)]
    assert np.frombuffer(both[0]([text])[0], "<u2").tolist() == both[1].encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_block_round_trip(values):
    control, data = tokens.encode_block(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert tokens.decode_block(control, data, len(values)).tolist() == values


# -- 4


def test_language(spark, data, odd, odd_rows, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.language_of_documents(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    got = langid.language_of_documents(odd).collect()
    known = {x for _, _, x, _ in odd_rows if x}
    for r in got:
        texts = [t for i, t, *_ in odd_rows if i == r["doc_id"]]
        letters = {bool(t and any(c.isalpha() for c in t)) for t in texts}
        if letters == {False}:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        if letters == {True}:
            assert r["lang_pred"] in known and 0 < r["score"] <= 1
    assert langid.language_of_documents(empty).collect() == []
    assert langid.keep_known(odd, model_of([("en", "one"), ("de", "two")])).columns == odd.columns


def model_of(rows):
    """A model of (lang, text) rows."""
    rows = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])
    words = pa.Table.from_batches(langid.word_counts([rows]))
    return langid.build(words, pa.Table.from_batches(langid.gram_counts(words.to_batches())))


def plain_language(rows, text):
    """(language, score) of a text by the stated rule, from (lang, text) rows."""
    langs = sorted({x for x, _ in rows})
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, n: list(w) if n == 1 else [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    tables = {0: defaultdict(lambda: defaultdict(int)), **{n: defaultdict(lambda: defaultdict(int)) for n in (4, 3, 2, 1)}}
    for lang, t in rows:
        for w in letters(t):
            tables[0][w][lang] += 1
            for n in (4, 3, 2, 1):
                for g in grams(w, n):
                    tables[n][g][lang] += 1
    total = {n: {x: sum(c[x] for c in tables[n].values()) + 0.5 * (len(tables[n]) + 1) for x in langs} for n in tables}
    score = lambda n, k: np.array([np.log((tables[n][k][x] + 0.5) / total[n][x]) for x in langs])
    words, logits = letters(text), np.zeros(len(langs))
    for w in words:
        if w in tables[0]:
            logits += score(0, w)
            continue
        for n in (4, 3, 2, 1):
            if known := [g for g in grams(w, n) if g in tables[n]]:
                logits += np.mean([score(n, g) for g in known], axis=0)
                break
    p = np.exp((logits - logits.max()) * min(1, 30 / len(words)))
    return langs[int(p.argmax())], p.max() / p.sum()


def test_language_by_the_rule():
    r = random.Random(6)
    word = {x: (lambda letters=letters: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))) for x, letters in (("de", "aeinrsthcwzüß"), ("en", "aeionrsthydw"), ("es", "aeosrnldcñó"))}
    rows = [(x, " ".join(f() for _ in range(40))) for x, f in word.items() for _ in range(6)]
    model = model_of(rows)
    predict = langid.Predictor(model)
    texts = [" ".join(word[r.choice(["de", "en", "es"])]() if r.random() < 0.5 else r.choice(r.choice(rows)[1].split()) for _ in range(r.randint(1, 50))) for _ in range(60)]
    for t in [*texts, "x" * 300 + "ñ", "Zebra " * 500, "qqq"]:
        lang, score = plain_language(rows, t)
        got = predict(t)
        assert got[0] == lang and abs(got[1] - score) < 1e-3


def test_backoff_order():
    p = langid.Predictor(model_of([("a", "zebra " * 5), ("b", "quilt " * 5)]))
    assert p("zebra")[0] == "a" and p("zebrx")[0] == "a" and p("quil")[0] == "b"
    assert p("zebra " * 50)[1] > p("zebra")[1]
    assert p("²³ 12")[0] == "und"


def test_long_words_are_fitted_whole():
    m = model_of([("a", ("e" * 64 + "zebra ") * 5), ("b", ("e" * 64 + "quilt ") * 5)])
    assert [langid.Predictor(m)(w)[0] for w in ("zebrx", "quilx")] == ["a", "b"]


# -- 5


def test_pages(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in rows.collect()}
    for r in pages.pages_digest(rows).collect():
        want = [b.text for b in pages.blocks_of(html[r["page_id"]]) if any(p.split(" ")[0] == "article" for p in b.path)]
        assert r["text"] == "\n\n".join(want) and r["n_chars"] == len(r["text"])
    r = random.Random(5)
    right = total = 0
    for _ in range(60):
        blocks, y = pages.labelled(pages.made_page(r))
        if blocks:
            q = pages.trained().label([blocks])[0] >= 0.5
            right, total = right + int((q == (y > 0)).sum()), total + len(y)
    assert right / total > 0.97


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, blocks string"
    rows = [(1, None, None, "x", "x"), (None, "u", "", "x", "x"), (2, "u", "plain &amp; simple\n text", "x", "x"), (2, "u", "<p>a<p>b" * 3, "x", "x"), (3, "u", "<div " * 500, "x", "x"), (4, "u", "<script>x</p>", "x", "x")]
    out = pages.pages_digest(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert pages.pages_digest(spark.createDataFrame([], schema)).collect() == []


def test_blocks():
    html = "<html><head><title>t</title><style>p{}</style></head><body><!-- <p>no</p> --><p>a&nbsp;b &lt;c<br>d<p><b>e</b> f<ul><li>g<li>h</ul><script>var x='</p>';</script>i</body>"
    assert [b.text for b in pages.blocks_of(html)] == ["a b <c d", "e f", "g", "h", "i"]


# -- 6


def plain_dedup(rows, length):
    """rows: (order, text). Removed bytes by the contract; equal orders don't see each other."""
    seen, out = {}, []
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raws:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            seen[s] = min(seen.get(s, i), i)
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(odd, odd_rows, empty):
    first = -(2**63)
    rows = [(first if i is None else i, t) for i, t, *_ in odd_rows]
    want = sorted((i, *w) for (i, _), w in zip(rows, plain_dedup(rows, 50), strict=True))
    got = sorted((first if r[0] is None else r[0], *r[1:]) for r in map(tuple, suffixes.substrings_digest(odd).collect()))
    assert got == want
    assert suffixes.substrings_digest(empty).collect() == []


@pytest.mark.parametrize("fan", [1, 3])
def test_substrings_dealt_again(spark, odd, odd_rows, monkeypatch, fan):
    """Packets that are dealt in many turns, and parts that send their contexts bit by bit."""
    monkeypatch.setattr(suffixes, "FAN_BITS", fan)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4096)
    monkeypatch.setattr(suffixes, "FLUSH_RECORDS", 50)
    monkeypatch.setattr(suffixes, "CONTEXT_ROWS", 20)
    first = -(2**63)
    rows = [(first if i is None else i, t) for i, t, *_ in odd_rows]
    want = sorted((i, *w) for (i, _), w in zip(rows, plain_dedup(rows, 50), strict=True))
    got = sorted((first if r[0] is None else r[0], *r[1:5]) for r in map(tuple, suffixes.dedup_substrings(odd).collect()))
    assert got == want
    with pytest.raises(TypeError, match="whole number"):
        suffixes.dedup_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_substrings_across_slabs(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 120, 400)]
    rows = [(i, "".join(x for _ in range(4) for x in (text(r.randint(0, 90)), r.choice(shared)))) for i in range(14)] + [(20, "xyz" * 60), (21, "q" + "xyz" * 40)]
    raws = [t.encode() for _, t in rows]
    monkeypatch.setattr(suffixes, "SLAB", 64)
    for raw in raws:
        at = {a + int(x) for a, _, where in suffixes.slabs(raw, 50) for x in where}
        monkeypatch.setattr(suffixes, "SLAB", 1 << 22)
        assert {int(x) for _, _, where in suffixes.slabs(raw, 50) for x in where} <= at | set()
        monkeypatch.setattr(suffixes, "SLAB", 64)
    monkeypatch.undo()
    got = sorted(map(tuple, suffixes.substrings_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(i, *w) for (i, _), w in zip(rows, plain_dedup(rows, 50), strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.binary(max_size=12) | st.sampled_from([b"a b", b"Ab, c.", b" x", b"x ", b"", b"(\ty)\n\x0b\x0cA", "É é".encode()]), max_size=6), st.integers(0, 6))
def test_coded_words(texts, cut):
    code, lengths, found = decontaminate.coded_words(pa.array(texts, pa.binary()).slice(cut))
    at = np.append(0, np.cumsum(lengths))
    assert [[found[c] for c in code[a:b]] for a, b in zip(at, at[1:])] == [decontaminate.words_of(t) for t in texts[cut:]]


def test_best_run_checks_few_runs(monkeypatch):
    """The best of all runs, though runs that hold too few words for it are passed over."""
    r = random.Random(5)
    pool = [b"w%d" % i for i in range(60)]
    space = decontaminate.Space(np.ones(1 << decontaminate.WORD_BITS), np.ones((1 << decontaminate.WORD_BITS, 2), np.float32), np.zeros(2))
    calls, starts, longest = [], 0, decontaminate.longest
    monkeypatch.setattr(decontaminate, "longest", lambda *x: calls.append(1) or longest(*x))
    for _ in range(40):
        item = r.sample(pool, 30)
        items = decontaminate.items_of([(1, b" ".join(item).decode())], space)
        words = [r.choice(pool) for _ in range(150)]
        words[60:85] = [w for w in item if r.random() < 0.8]
        n, span, (places, size) = len(item), int(items.spans[0]), items.answers[0]
        every = [(decontaminate.lcs(item, words[a : a + span]) / n, decontaminate.common(places, size, words[a : a + span]) / size, -a) for a, w in enumerate(words) if w in item]
        fit = [x for x in every if x[0] >= decontaminate.STRONG or x[0] >= decontaminate.WEAK and x[1] >= decontaminate.ANSWER]
        calls.clear()
        assert decontaminate.best_run(words, items, 0, 0, len(words)) == max(fit, default=None)
        starts += len(every)
        test_best_run_checks_few_runs.__dict__.setdefault("n", []).append(len(calls))
    assert sum(test_best_run_checks_few_runs.n) < starts / 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.integers(2, 9))
def test_interval_expansion(symbols, length):
    t = np.array([*symbols, 0], np.uint16)
    order, group = suffixes.common_strings(t, length)
    strings = [tuple(t[p : p + length]) for p in order]
    for a in range(1, len(t)):
        if len(strings[a]) == len(strings[a - 1]) == length and 0 not in strings[a] and 0 not in strings[a - 1]:
            assert (group[a] == group[a - 1]) == (strings[a] == strings[a - 1])


# -- 7


def test_leaks(spark, odd, empty):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("bcdfghaeiou") for _ in range(r.randint(3, 7))) for _ in range(900)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    items = [(i, f"{sentence(14)} {sentence(12)} {sentence(7)}") for i in range(12)] + [(90, None), (91, ""), (92, "tiny item")]
    docs = [(i, " ".join(sentence(12) for _ in range(20)), i) for i in range(60)]
    exact = {3: 0, 9: 4, 30: 11}
    for d, i in exact.items():
        docs[d] = (d, f"{docs[d][1]} {items[i][1]} {sentence(30)}", d)
    changed = items[6][1].split()
    for p in range(2, len(changed) - 8, 6):
        changed[p] = r.choice(vocabulary)
    docs[40] = (40, f"{sentence(25)} {' '.join(changed).upper()} {docs[40][1]}", 40)
    docs[41] = (41, f"{sentence(40)} {' '.join(items[7][1].split()[:9])} {sentence(60)}", 41)
    docs += [(70, None, 0), (71, "", 0), (72, "the tiny item here", 0), (3, docs[3][1], 0)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, cosine long"), benchmark).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {*exact.items(), (40, 6), (72, 92)}
    two = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, cosine long"), benchmark, item_block=5).collect()
    near = lambda found: sorted((x["doc_id"], x["item_id"], x["similarity"], x["answer_similarity"], x["word_start"]) for x in found)
    assert near(two) == near(got)  # the cosine depends on the order of sums, in its last places
    assert decontaminate.find_leaks(odd, benchmark).collect() == []
    assert decontaminate.find_leaks(empty, benchmark).collect() == []
    clean = decontaminate.keep_clean(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == odd.count()


def test_keep_clean_of_null_and_repeated_ids(spark):
    r = random.Random(5)
    pick = lambda n: " ".join("".join(r.choice("bcdfghaeiou") for _ in range(5)) for _ in range(n))
    item, clean = pick(30), [pick(60) for _ in range(4)]
    leak = f"{pick(20)} {item} {pick(20)}"
    docs = spark.createDataFrame([(None, leak), (None, clean[0]), (1, leak), (1, clean[1]), (2, clean[2]), (3, None), (None, None)], "doc_id long, text string")
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert {(x["doc_id"], x["text"]) for x in kept} == {(None, clean[0]), (1, clean[1]), (2, clean[2]), (3, None), (None, None)}


def plain_leaks(docs, items):
    """Best similarity, answer's and first start by the stated rule, over the runs from every word."""
    found = {}
    for i, item in items:
        item, answer = decontaminate.words_of(item), decontaminate.answer_of(item)
        span = round(decontaminate.SPAN * len(item))
        for d, text in docs:
            text = decontaminate.words_of(text)
            for a in (a for a, w in enumerate(text) if w in item):
                run = text[a : a + span]
                x, y = decontaminate.lcs(item, run) / len(item), decontaminate.lcs(answer, run) / len(answer)
                if x >= 0.8 or (x >= 0.6 and y >= 0.6):
                    found[d, i] = max(found.get((d, i), (0,)), (x, y, -a))
    return found


def test_leaks_by_the_rule(spark, monkeypatch):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("bcdfghaeiou") for _ in range(r.randint(2, 6))) for _ in range(500)]
    pick = lambda n: [vocabulary[int(500 * r.random() ** 3)] for _ in range(n)]
    items, docs = [], []
    for i in range(14):
        answer = pick(r.randint(3, 8))
        items.append((i, f"{' '.join(pick(r.randint(8, 45)))}. {' '.join(answer)}."))
        for _ in range(4):
            body, tail = (part.split() for part in items[-1][1].rstrip(".").split(". "))
            keep, grow = r.uniform(0.55, 1), r.uniform(1, 1.45)
            out = [w if r.random() < keep else pick(1)[0] for w in body] + tail
            for _ in range(int((grow - 1) * len(out))):
                out.insert(r.randrange(1, len(out)), pick(1)[0])
            docs.append((len(docs), " ".join(pick(r.randint(0, 90)) + out + pick(r.randint(0, 90)))))
    items += [(20, "five words are an item"), (21, docs[0][1])]
    docs += [(90, "here five words are an item too"), (91, "five words which are an item"), (92, " ".join(pick(3000)))]
    want = plain_leaks(docs, items)
    assert sum(x[0] < 0.8 for x in want.values()) > 5 and len(want) > 35
    monkeypatch.setattr(decontaminate, "CHUNK", 100)
    space = decontaminate.latent_space(spark.createDataFrame(docs, "doc_id long, text string"))
    texts = [decontaminate.words_of(t) for _, t in docs]
    few = {(docs[t][0], i): (x, y, -at) for t, i, x, y, _, at in decontaminate.leaks_of(texts, space, decontaminate.items_of(items, space))}
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert few == {(x["doc_id"], x["item_id"]): (x["similarity"], x["answer_similarity"], -x["word_start"]) for x in got} == want


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12))
def test_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = table[i - 1, j - 1] + 1 if x == y else max(table[i - 1, j], table[i, j - 1])
    assert decontaminate.lcs(a, b) == table[-1, -1]


# -- 8


def shingles(text, n):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = words(low)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_components(rows, n, num, den):
    """(set size, smallest id) of each (id, text)."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [(len(sets[x]), i if not sets[x] else least.get(find(x), i)) for x, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("setting", [jaccard.CONTRACT, jaccard.DEFAULT])
def test_jaccard(odd, odd_rows, empty, setting):
    rows = [(i, t) for i, t, *_ in odd_rows]
    want = sorted(((i, *w) for (i, _), w in zip(rows, plain_components(rows, *setting), strict=True)), key=key)
    assert sorted(map(tuple, jaccard.jaccard_components(odd, *setting).collect()), key=key) == want
    assert jaccard.jaccard_components(empty, *setting).collect() == []


def test_last_plan_is_small(spark):
    # The driver plans and runs all stages of it at once.
    rows = [(i, " ".join(f"w{i % 7}x{k}" for k in range(40 + i % 3))) for i in range(40)]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") < 16


def test_keep_one_of_null_and_repeated_ids(spark):
    r = random.Random(15)
    pick = lambda n: " ".join("".join(r.choice("bcdfghaeiou") for _ in range(5)) for _ in range(n))
    a, b, c, d = (pick(60) for _ in range(4))
    rows = [(None, a), (9, a), (10, a), (-4, b), (2, b), (2, c), (None, d), (None, None), (7, ""), (8, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["text"]) for x in kept} == {(9, a), (-4, b), (2, c), (None, d), (None, None), (7, ""), (8, "")}


def near_copies(seed, sizes, copies, most):
    """Chains and clouds of near copies, some with edits of their own and some with edits of others, with a passage in all."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(2000)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for size in sizes:
        base = [r.choice(vocabulary) for _ in range(size)] + passage
        chain = list(base)
        for _ in range(copies):
            for _ in range(r.randint(0, 3)):
                chain[r.randrange(size)] = r.choice(vocabulary)
            cloud = list(base)
            for _ in range(r.randint(0, most)):
                cloud[r.randrange(size)] = r.choice(vocabulary)
            if r.random() < 0.3:
                at = r.randrange(size // 2)
                del cloud[at : at + r.randint(1, size // 6)]
            rows += [" ".join(chain), " ".join(cloud)]
    return list(enumerate(rows))


@pytest.mark.parametrize("setting", [jaccard.CONTRACT, jaccard.DEFAULT])
@pytest.mark.parametrize("hot", [2, 256])
def test_jaccard_of_many_near_copies(spark, setting, hot):
    rows = near_copies(4 + hot, (12, 40, 90, 150), 40, 14)
    want = sorted((d, *w) for (d, _), w in zip(rows, plain_components(rows, *setting), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard.jaccard_components(docs, *setting, hot=hot).collect()))
    assert got == want
    assert len({w for *_, w in want}) < len(rows) - 20


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 160), st.integers(0, 40), st.sampled_from([(9, 10), (4, 5)]), st.integers(0, 10**6))
def test_similar_sets_share_keys(size, edits, ratio, seed):
    r = np.random.default_rng(seed)
    pool = np.unique(r.integers(0, 2**64, 400, np.uint64))
    r.shuffle(pool)
    a = np.sort(pool[:size])
    b = np.sort(np.concatenate([a[min(edits, size - 1) :], pool[size : size + edits]]))
    both, num, den = len(np.intersect1d(a, b)), *ratio
    if den * both >= num * (len(a) + len(b) - both):
        (x, sx), (y, sy) = jaccard.fragment_keys(a, num, den), jaccard.fragment_keys(b, num, den)
        shared = [int((np.intersect1d(x, y) & np.uint64(1) == half).sum()) for half in (0, 1)]
        assert any(n and n >= max(sx[half], sy[half]) for half, n in enumerate(shared))


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 2), st.integers(0, 5)), max_size=40), st.integers(1, 5))
def test_texts_of_a_key_meet_their_pivot(rows, size):
    rows = sorted(((s << jaccard.NUMBER_BITS) + k, h) for k, s, h in rows)
    batches = (jaccard.batch_of(key=np.array([k for k, _ in rows[a : a + size]]), who=np.array([h for _, h in rows[a : a + size]])) for a in range(0, len(rows), size))
    got = sorted((x["key"], x["who"], x["pivot"]) for b in jaccard._meet(batches) for x in b.to_pylist())
    groups = defaultdict(set)
    for k, h in rows:
        groups[k].add(h)
    salted = lambda k: k >> jaccard.NUMBER_BITS
    assert got == sorted((k, h, -1 if salted(k) else min(g)) for k, g in groups.items() for h in g if salted(k) or len(g) > 1)


# -- 9


def spark_hash(value, seed=42):
    raw = value.encode() if isinstance(value, str) else (value & (2**64 - 1)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain_lines(rows, gram, window):
    """Removed line numbers (among non-blank lines) by winnowing, for distinct (id, text)."""
    docs = {}
    for i, t in rows:
        if t is not None:
            kept = [x for x in t.split("\n") if x.translate(str.maketrans("\t\r\x0b\x0c", "    ")).strip(" ")]
            docs[(-(1 << 63) if i is None else i, signed(spark_hash(t)))] = [signed(spark_hash(x)) for x in kept]
    first, marks = {}, []
    for k in sorted(docs):
        h, g = docs[k], []
        for a in range(len(h) - gram + 1):
            s = 42
            for x in h[a : a + gram]:
                s = spark_hash(x, s)
            g.append(signed(s))
        width = min(window, len(g))
        for p in sorted({min(range(a, a + width), key=lambda q: (g[q], q)) for a in range(len(g) - width + 1)} if g else ()):
            marks.append((k, p, g[p]))
            first.setdefault(g[p], (k, p))
    gone = defaultdict(set)
    for k, p, fp in marks:
        src, q = first[fp]
        if (src, q) < (k, p):
            h, s, d = docs[k], docs[src], q - p
            same = lambda x: 0 <= x < len(h) and 0 <= x + d < len(s) and h[x] == s[x + d]  # noqa: B023, E731
            a = b = p
            while same(a - 1):
                a -= 1
            while same(b):
                b += 1
            gone[k].update(range(a, b))
    return gone


@pytest.mark.parametrize("setting", [(2, 2), (1, 1), (2, 3)])
def test_lines(spark, odd, odd_rows, empty, setting):
    r = random.Random(6)
    pool = [f"line {i}" for i in range(25)] + ["", "  "]
    many = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(100, 140)]
    for df, rows in ((odd, [(i, t) for i, t, *_ in odd_rows]), (spark.createDataFrame(many, "doc_id long, text string"), many)):
        gone = plain_lines(rows, *setting)
        want = []
        for i, t in rows:
            k = (-(1 << 63) if i is None else i, signed(spark_hash(t)) if t is not None else 42)
            out, n = [], 0
            for x in (t or "").split("\n"):
                blank = not x.translate(str.maketrans("\t\r\x0b\x0c", "    ")).strip(" ")
                if blank or n not in gone[k]:
                    out.append(x)
                n += not blank
            want.append((i, None if t is None else "\n".join(out), len(gone[k]) if t is not None else 0))
        got = [(x["doc_id"], x["kept_text"], x["n_removed"]) for x in lines.dedup_lines(df, *setting).collect()]
        assert sorted(got, key=lambda x: repr(x)) == sorted(want, key=lambda x: repr(x))
    assert lines.lines_digest(empty).collect() == []


def plain_later_lines(rows):
    """What is left of each (id, text) when every non-blank line that stood earlier goes."""
    seen, left = set(), []
    for i, t in rows:
        out = []
        for x in t.split("\n"):
            if x.strip(" \t\r\x0b\x0c") and x in seen:
                continue
            seen.add(x)
            out.append(x)
        left.append((i, "\n".join(out)))
    return left


def test_single_lines(spark):
    r = random.Random(7)
    pool = [f"a licence line of some words {i}" for i in range(12)] + ["}", "", "\t "]
    rows = [(1, "one line text"), (2, "one line text"), (3, "own\none line text\nwords"), (4, "again\nown\nagain\n\n  \nagain")]
    rows += [(i, "\n".join([f"own {i}", r.choice(pool), f"more {i}", *r.choices(pool, k=r.randint(0, 4))])) for i in range(5, 40)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["kept_text"]) for x in got) == plain_later_lines(rows)
    sizes = {x["doc_id"]: (x["n_lines"], x["n_removed"]) for x in got}
    assert (sizes[2], sizes[3], sizes[4]) == ((1, 1), (3, 1), (6, 3))


def plain_passages(rows, length):
    """(lines removed, what is left) of each (id, text): lines that stood earlier, or whose words all are in runs that did."""
    lines_seen, places, found = set(), {}, {}
    for i, t in sorted(rows):
        kept = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        words = [(w, n) for n, x in enumerate(kept) for w in x.split()]
        covered = set()
        for a in range(len(words) - length + 1):
            run = tuple(w for w, _ in words[a : a + length])
            src = places.setdefault(run, (i, a))
            if src[0] != i or a >= src[1] + length:
                covered.update(range(a, a + length))
        stay = {n for k, (_, n) in enumerate(words) if k not in covered}
        left, n, gone = [], 0, 0
        for x in t.split("\n"):
            if x.strip(" \t\r\x0b\x0c"):
                go = x in lines_seen or n not in stay
                lines_seen.add(x)
                n, gone = n + 1, gone + go
                if go:
                    continue
            left.append(x)
        found[i] = gone, "\n".join(left)
    return found


def test_map_of_shared_fingerprints(spark):
    """All marks of shared fingerprints pass the map, and few others do."""
    marks = spark.range(20_000).selectExpr("id as fp", "id % 7 as _id")
    got = {r["fp"] for r in lines._among(marks, marks.where("fp % 100 = 0"), "fp").collect()}
    assert got >= set(range(0, 20_000, 100)) and len(got) < 300


def test_lines_of_passages(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(1, 6))) for _ in range(90)]
    text = [r.choice(words) for _ in range(400)]
    wrap = lambda w, k: "\n".join(" ".join(w[a : a + k]) for a in range(0, len(w), k))
    # Wrapped anew, cut off, put together, periodic, repeated in one text, with other white space, and short ones.
    rows = [(1, wrap(text, 30)), (2, wrap(text, 13)), (3, wrap(text[50:141], 30)), (4, wrap(text[:60] + text[200:260], 12)), (5, " ".join(text[7:90])), (6, "ha " * 70), (7, "ha " * 45)]
    rows += [(8, wrap(text[:100], 9).replace(" ", " \t ")), (9, "own words\n\n" + wrap(text[300:320], 8) + "\n \nown too"), (10, wrap(text[300:319], 8)), (11, "ho " * 30 + "\n" + "ho " * 25), (12, "")]
    for i in range(13, 60):
        a, b = r.randint(0, 380), r.randint(0, 380)
        part = text[a : a + r.randint(5, 80)] + r.choice([[], ["between"]]) + text[b : b + r.randint(5, 80)]
        rows.append((i, wrap(part, r.randint(5, 40))))
    want = plain_passages(rows, sum(lines.PASSAGE) - 1)
    got = {x["doc_id"]: (x["n_removed"], x["kept_sha256"]) for x in lines.lines_digest(spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")).collect()}
    assert got.pop(99) == (0, hashlib.sha256(b"").hexdigest())
    assert got == {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, (n, t) in want.items()}
    assert want[2][0] == 31 and want[5][0] == 1 and want[9][0] == 3 and want[10][0] < 3


def uncovered(rows, kept, length):
    """Lines of later runs of so many lines that are kept, though the run stood earlier."""
    seen, found = set(), 0
    for i, t in sorted(rows):
        h = t.split("\n")
        gone, left = set(range(len(h))), iter(enumerate(h))
        for x in kept[i].split("\n") if kept[i] else []:
            gone.discard(next(n for n, y in left if x == y))
        for a in range(len(h) - length + 1):
            run = tuple(h[a : a + length])
            found += run in seen and len(set(range(a, a + length)) - gone)
            seen.add(run)
    return found


@pytest.mark.parametrize("setting", [(), (2, 2), (2, 3), (1, 3)])
def test_runs_that_stood_earlier_go(spark, setting):
    r = random.Random(9)
    rows, n = [], 0
    for k in range(30):
        # The outer pair of a run first stands with other neighbours; which pair that is hurts depends on the hash.
        x = [f"run {k} line {i}" for i in range(r.randint(3, 6))]
        cut = r.randint(2, len(x) - 1)
        for part in (x[:cut], x[-cut:], x, [f"head {k}", *x, f"tail {k}"]):
            n += 1
            rows.append((n, "\n".join([f"own {n}", *part])))
    got = {x["doc_id"]: x["kept_text"] for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), *setting).collect()}
    assert uncovered(rows, got, sum(setting) - 1 if setting else 1) == 0
    assert all(f"own {i}" in t for i, t in got.items())


# -- 10


def plain_pii(text):
    text, found = text or "", []
    found += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


PIECES = ["a", "b.c", "@", "x@y.z", "@@", "..", ".", " ", "-", "1", "12", "255", "256", "1.2.3.4", "10.0.0.300", "+1 (555) 010-99 99", "+", "4111 1111 1111 1111", "4111111111111112", "é", "%", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans(text):
    assert [s[:3] for s in pii.spans_of(text) if s[4]] == plain_pii(text)


def test_pii(spark, odd, odd_rows, empty):
    texts = [(1, "call +44 (20) 7946-0958 or mail a.b@c.example.org; IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, None), (3, "ssn 078-05-1120 and part 078-05-1120"), (4, "GB83 WEST 1234 5698 7654 32")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pii_digest(df).collect()}
    for i, t in texts:
        base = plain_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[0] == k for x in base) for k in pii.KINDS[:4]]
    assert "iban:56:83" in got[1]["spans"] and "iban" not in got[4]["spans"]
    assert got[3]["spans"] == "national_id:4:15"
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[3] == "ssn [national_id] and part 078-05-1120"
    assert pii.pii_digest(odd).count() == len(odd_rows) and pii.pii_digest(empty).collect() == []


def test_pii_is_linear():
    import time

    began = time.process_time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        pii.spans_of(text)
    assert time.process_time() - began < 20
