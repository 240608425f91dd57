"""The operators for training data against plain definitions of what they give."""

import collections
import hashlib
import itertools
import json
import random
import re
import struct
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from colligo.llm import bpe, chat, html_text, ngram_join, packing, pii, quality_classifier, quality_rules, secrets, topk
from colligo.llm.components import components
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, white space, one word, long, repeated and non-ASCII texts.
HARD = [None, "", " \n\t ", "word", "a b c d", "x " * 3000, "The same line\nThe same line\n\nThe same line", "é ü 漢字 😀 \x85 \xa0 ſ", "#$% <b>|&*"]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 1, 2: spans ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    digits = [int(c) for c in v if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_pii(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if valid(k, m[0]))


def test_pii_base_against_python(spark):
    rng = random.Random(1)
    parts = ["a", "@", ".", "b.c", "1", "23", "+1", " ", "-", "(", "4111 1111 1111 1111", "10.0.0.1", "256", "é", "😀", "x_y", "%"]
    texts = HARD + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)] + ["4" * 2000 + "a" * 2000 + "@x.y", "a@b" + ".c" * 3000]
    got = {r["doc_id"]: r for r in pii.detect(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(base_pii(t).encode()).hexdigest(), t
        assert got[i]["n_email"] == base_pii(t).count("email")


def test_pii_bootstraps_from_contexts(spark):
    seeds = [f"Call tel: +1 555 000 {1000 + i} now" for i in range(8)]
    texts = seeds + ["Call tel: 5550001234567 now", "The number: 5550001234567x stays", "about 123456789 apples", None]
    rows = {r["doc_id"]: r for r in pii.detect(frame(spark, texts)).collect()}
    assert rows[8]["n_more"] == 1 and rows[8]["spans"] == "phone:10:23" and rows[9]["n_more"] == 0 and rows[10]["n_more"] == 0
    kept = {r["doc_id"]: r for r in pii.masked(frame(spark, texts).withColumn("base", F.lit(1)).withColumn("rid", F.lit(2))).collect()}
    assert kept[8]["text"] == "Call tel: [PHONE] now" and kept[8]["n_chars"] == 21 and kept[10]["text"] == texts[10] and kept[11]["text"] is None and kept[0]["rid"] == 2


def test_pii_patterns_grow(spark):
    """Identifiers learnt in one context teach another one, which has no seed; and two words may say what one does not."""
    seeds = [f"Call tel: +1 555 000 {1000 + i} now" for i in range(200)]
    learnt = [f"Call tel: 555{100 + i}4567z now" for i in range(20)] + [f"the fon: 555{100 + i}4567z is his" for i in range(20)]
    pairs = [f"my own number +1 555 111 {1000 + i} yes" for i in range(20)] + [f"the lot number 77{i}881234x" for i in range(30)]
    texts = seeds + learnt + pairs + ["the fon: 999888777x is hers", "see 999888777y too", "my own number 4400440044z yes"]
    rows = {r["doc_id"]: r["n_more"] for r in pii.detect(frame(spark, texts)).collect()}
    new = len(texts) - 3
    assert [rows[i] for i in range(200, 240)] == [1] * 40 and (rows[new], rows[new + 1], rows[new + 2]) == (1, 0, 1)
    assert not any(rows[i] for i in range(240, new))


def test_pii_of_very_long_texts(spark):
    """Positions and masks over many strides and pieces, with letters of two units."""
    rng = random.Random(2)
    text = "".join(rng.choice(["😀 ", "a@b.cc ", "word ", "10.0.0.1 ", "+1 555 000 1234 / ", "é", "4111 1111 1111 1111, "]) for _ in range(20000))
    got = pii.detect(frame(spark, [text, "x" * 300000, "1@" * 50000])).orderBy("doc_id").first()
    assert got["base_sha256"] == hashlib.sha256(base_pii(text).encode()).hexdigest()
    spans = sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in got["spans"].split(","))
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    assert pii.masked(frame(spark, [text])).first()["text"] == "".join(out) + text[at:]


def test_pii_of_nothing(spark):
    empty = frame(spark, ["x"]).limit(0)
    assert pii.detect(empty).count() == 0 and pii.masked(empty).columns == empty.columns


def test_secrets(spark):
    values = ['api_key = "abcdef123"', "TOKEN:short", "AKIA" + "A" * 16, "AKIASHORT", "f" * 24, "f" * 23, "password=hunter2hunter2", "paſſword=hunter22"]
    texts = HARD + values + ["client key Zx9kQ2mLp7Rt4WvB8nYc1sD end", "client key your-api-key-here-123 end", "plain Zx9kQ2mLp7Rt4WvB8nYc1sD end"]
    got = [r for r in secrets.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    counts = [(r["n_assign"], r["n_access"], r["n_hex"], r["n_novel"]) for r in got[len(HARD) :]]
    assert counts == [(1, 0, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert got[len(HARD)]["spans"] == "assign:0:20" and all(r["spans"] == "" for r in got[: len(HARD)])
    assert secrets.scan(frame(spark, [])).count() == 0


def test_secrets_behind_the_most_sensitive_words(spark):
    value = "Zx9kQ2mLp7Rt4WvB8nYc1sD"
    texts = [f"run --token {value}", f"the secret is {value}", f"<secret>{value}</secret>", f'token = new Token("{value}")', f"password -> {value}", f"passwd {value}", f"api {value}"]
    texts += ["the secret is misunderstandings", "token your-api-key-here-123 end"]
    got = secrets.scan(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["found"] for r in got] == [[value]] * 7 + [[], []]


def test_secrets_once_twice_and_in_lists():
    """Random strings are found however often they occur and whatever secrets stand around them; the same strings in plain contexts are not."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    value = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(20, 40))) + "7"
    found = lambda t: [t[s:e] for _, s, e in secrets.novel_spans(t, [])]
    caught = collections.Counter()
    for _ in range(200):
        v, others = value(), [value() for _ in range(6)]
        caught["once"] += found(f"{prose(rng, 9)} the token is {v} {prose(rng, 9)}") == [v]
        caught["twice"] += found(f"the token is {v} {prose(rng, 3)} {v} end") == [v, v]
        caught["listed"] += v in found("tokens: " + " ".join([*others[:3], v, *others[3:]]))
        caught["far"] += found(f"the password is stored as {prose(rng, 15)} here: {v}") == [v]
        caught["plain"] += bool(found(f"{prose(rng, 30)} monkeys {v} {prose(rng, 9)}"))
        caught["too far"] += bool(found(f"the password {prose(rng, 40)} {v}"))
    assert all(caught[k] >= 190 for k in ("once", "twice", "listed", "far")) and not caught["plain"] and not caught["too far"], caught


def test_secrets_surroundings_and_contexts():
    text = "monkey and so on Abc123Def456Ghi789 password"
    assert not secrets.Contexts(text).sensitive(text.index("Abc")) and secrets.Contexts("my_API-x").sensitive(8) and not secrets.Contexts("").sensitive(0)
    assert secrets.Contexts("password " + "w " * (secrets.CONTEXT - 1)).sensitive(1000) and not secrets.Contexts("password " + "w " * secrets.CONTEXT).sensitive(1000)
    v = "Zx9kQ2pLm7Rt4VbW8nYc"
    long_ = f"{'k7' * 200} before {v} after {'k7' * 200}"
    at = long_.index(v)
    assert secrets.around(long_, at, at + len(v)) == (" before ", " after ") and secrets.around(v, 0, len(v)) == ("", "")
    # A plain measure of novelty: the same sizes without what is remembered.
    pack = secrets._compressor(tuple(secrets.IDENTIFIERS)).compress
    base = " ".join(secrets.IDENTIFIERS) + "\nthe token \n end\n"
    assert secrets.marginal_bytes(v, "the token ", f" end{v}") == len(pack((base + v).encode())) - len(pack(base.encode()))


def test_secrets_base_against_plain_patterns():
    rng = random.Random(9)
    parts = ["password", "SECRET", "api_key", "apikey", "token", "'", '"', " ", ":", "=", "abc", "A1+/", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.base_spans(t) == want, t


# --- 3, 8: quality ---


def counts_of(t):
    w, seen, dup, inside = words(t), set(), 0, set()
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = collections.Counter(windows)
    for i, g in enumerate(windows):
        if often[g] > 1:
            inside.update(range(i, i + 5))
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t or "")), "n_dup_lines": dup, "n_repeat_words": len(inside)}


def test_text_counts():
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice(["a", "b", " ", "\n", "\t", "#", "é"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    got = quality_rules.text_counts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert {k: int(got[k][i]) for k in counts_of(t)} == counts_of(t), t


def test_quality_rules(spark):
    rng = random.Random(3)
    good = [prose(rng, rng.randrange(20, 200)) for _ in range(400)]
    bad = [" ".join(w + "&&&" for w in prose(rng, 80).split()) for _ in range(20)] + [" ".join(w.upper() * 3 + "!!" for w in prose(rng, 80).split()) for _ in range(20)]
    rows = {r["doc_id"]: r for r in quality_rules.quality(frame(spark, good + bad + HARD)).collect()}
    assert all(rows[i]["kept"] for i in range(400)) and not any(rows[i]["kept"] for i in range(400, 440))
    assert not any(rows[440 + i]["kept"] for i in range(len(HARD))) and len(rows) == 440 + len(HARD)
    docs = frame(spark, good + bad + HARD).withColumn("kept", F.lit("mine")).withColumn("z0", F.lit(1)).withColumn("source", F.lit(None).cast("string"))
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 400 and kept.first()["kept"] == "mine"
    assert quality_rules.quality(frame(spark, [])).count() == 0 and quality_rules.keep(frame(spark, ["short"])).count() == 0


def test_robust_estimate_ignores_a_contaminated_quarter(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 100), "en", "s", 0) for i in range(300)] + [(i, "#&| " * 100 + str(i), "en", "s", 0) for i in range(300, 390)]
    got = quality_rules.quality(spark.createDataFrame(rows, DOCS)).where("kept").count()
    assert got == 300


def test_estimate_against_the_best_subset(spark):
    """Of a small table no three quarters have a much smaller determinant than those that the estimate rests on."""
    rng, p, floors = np.random.default_rng(4), len(quality_rules.FLOORS), np.diag(np.square(quality_rules.FLOORS))
    for case in range(3):
        words = [" ".join("w" * int(rng.integers(2, 5)) for _ in range(40)) for _ in range(9)] + [" ".join("W#" * int(rng.integers(3, 9)) for _ in range(30 + case)) for _ in range(3)]
        counts = quality_rules.counted(frame(spark, words), ["lang", "source"])
        z = np.array([list(r) for r in counts.select(*quality_rules.vector()).collect()]) / quality_rules.SCALE
        got = quality_rules.fit(counts).where("level = 2").first()
        cov = lambda rows: np.cov(rows.T, bias=True) * quality_rules._consistency(p) + floors
        best = min(np.linalg.slogdet(cov(z[list(own)]))[1] for own in itertools.combinations(range(12), 9))
        assert -np.linalg.slogdet(np.reshape(got["inverse"], (p, p)))[1] <= best + 0.3 and got["rows"] == 12


def test_small_tables_and_groups_are_judged(spark):
    rng = random.Random(6)
    strange = " ".join(w + "#$%&" for w in prose(rng, 60, 5000).split())
    plain = [prose(rng, rng.randrange(30, 200), 5000) for _ in range(60)]
    rows = quality_rules.quality(frame(spark, [*plain, strange])).collect()
    assert all(r["distance"] is not None and r["kept"] == (r["doc_id"] < 60) for r in rows)
    # A text is judged nearly alike whether its group has 199 rows or 200.
    far = {}
    for n in (199, 200):
        other = [(i, prose(random.Random(i), 80, 5000), "en", "s", 0) for i in range(1000)]
        capitals = [(1000 + i, prose(random.Random(i), 80, 5000).replace("w", "W" if i % 2 else "WW"), "en", "t", 0) for i in range(n)]
        got = quality_rules.quality(spark.createDataFrame(other + capitals, DOCS)).where("doc_id = 1000").collect()
        far[n] = got[0]["distance"]
    assert far[199] == pytest.approx(far[200], rel=0.05)


def test_quality_classifier_held_out(spark):
    rng = random.Random(4)
    good = [prose(rng, rng.randrange(20, 120)) for _ in range(300)]
    bad = [" ".join(w + rng.choice(["&&&", "$$$"]) for w in prose(rng, rng.randrange(20, 120)).split()) for _ in range(100)]
    docs = frame(spark, good + bad + HARD)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = [r for r in quality_classifier.classify(docs, labels).collect()]
    assert len(rows) == 400 + len(HARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] < 300) for r in held) >= 0.97 * len(held)
    clash = docs.withColumn("score", F.lit("mine"))
    assert quality_classifier.keep(clash, labels).columns == clash.columns
    assert all(r["score"] == 0.5 for r in quality_classifier.classify(docs, labels.limit(0)).collect())


def test_votes_against_plain_loops():
    """Scores of a model against its definition, one text and one neighbour at a time; of equal neighbours the first count."""
    rng = np.random.default_rng(6)
    sample = rng.normal(size=(80, 4))
    sample = np.concatenate([sample, sample[:30]])  # ties
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    good, weight = rng.integers(0, 2, 110).astype(float), rng.random(110)
    model = quality_classifier.Model(np.ones(4), np.eye(4), sample, good, weight, 0.4)
    x = np.concatenate([rng.normal(size=(300, 4)), np.zeros((1, 4))])
    got = model.score(x)
    for row, score in zip(x, got):
        norm = np.linalg.norm(row)
        near = [round(float(row @ v) / norm, quality_classifier.DIGITS) if norm else 0.0 for v in sample]
        best = sorted(range(110), key=lambda i: (-near[i], i))[: quality_classifier.NEIGHBOURS]
        votes = [(max(near[i], 0.0) ** 4 * weight[i], good[i]) for i in best]
        total = sum(v for v, _ in votes)
        assert score == pytest.approx(sum(v * g for v, g in votes) / total if total else 0.4, abs=1e-9)


def test_quality_classifier_samples_what_the_docs_have(spark):
    labels = spark.createDataFrame([(i, int(i >= 400), 0) for i in range(800)], "doc_id long, quality int, toxic int")
    free = [(r["doc_id"], r["quality"]) for r in labels.where(~quality_classifier.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    # Of each label the docs have the ids that come last: 30 of label 0, 10 of label 1.
    ids = [i for i, g in free if g == 0][-30:] + [i for i, g in free if g == 1][-10:]
    docs = frame(spark, [prose(random.Random(i), 30) for i in range(800)]).where(F.col("doc_id").isin(ids))
    model = quality_classifier.fit(docs, labels, sample=20)
    assert [int((model.good == g).sum()) for g in (0, 1)] == [20, 10]
    # Shares and weights are those of the 40 labelled rows that the docs have.
    assert model.prior == 0.25 and model.weight[model.good == 0] == pytest.approx(1) and model.weight[model.good == 1] == pytest.approx(10 / 10 / (30 / 20))


# --- 4: pages ---


def test_html_blocks():
    page = "<!DOCTYPE html><html><head><title>t</title></head><body><!-- x > y --><nav><ul><li><a href='/a>b'>m</a></li></ul></nav><article><h1>A &amp; B</h1><p>one<b>two</b>\n three<p>four<br>five &am</article><script>if (a<b) {'</p>'}</script>tail"
    assert [b.text for b in html_text.blocks(page)] == ["m", "A & B", "onetwo three", "four five &am", "tail"]


def test_html_unclosed_hidden_elements():
    text = lambda page: " ".join(b.text for b in html_text.blocks(page))
    for tag in "select object svg canvas audio video noscript template".split():
        assert text(f"<article><p>one</p><{tag}><p>two</p></article>") == "one two"
        assert text(f"<article><p>one</p><{tag}><p>two</p><{tag}>hidden</{tag}><p>three</p></article>") == "one two three"
        assert text(f"<p>one</p><{tag}>hidden<{tag}>hidden</{tag}>hidden</{tag.upper()}><p>two</p>") == "one two"
    assert text("<head><title>x</title><article><header>one</header></article>") == "one"
    assert text("<p>one</p><script>two") == "one"
    assert text("<p>\u0130</p><script>x</SCRIPT><style>y</STYLE ><p>two</p>") == "\u0130 two"
    assert text("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>") == "If x=2 then"
    assert len(html_text.blocks("<select>" * 50000 + "<p>one</p>")) == 1


def test_html_main_text(spark):
    model = html_text.train(html_text.training_pages())
    held, errors = 0, 0
    for page, labels in html_text.training_pages(100, seed=1234):
        held += len(labels)
        errors += sum(a != b for a, b in zip(model.decode(page), labels))
    assert errors <= 0.02 * held
    page = "<html><body><header><nav><a>Home</a></nav></header><div class='cookie-consent'>We use cookies. <button>OK</button></div><main><h1>Title</h1><p>First text here.</p><div class='ad'>Buy now.</div><p>Second one.</p></main><section id='comments'><p>Nice post.</p></section><footer>&copy; me</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p"), (5, "x", "<" * 5000)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages, model).collect()}
    assert got[1] == ("Title First text here. Second one.", 34) and got[2] == ("", 0) and got[3] == ("", 0) and len(got) == 5


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, step, scores = 6, rng.normal(size=(2, 2)), rng.normal(size=6)
        model = html_text.Field({str(i): s for i, s in enumerate(scores)}, step)
        path = model.decode([html_text.Block("", [str(i)]) for i in range(n)])
        value = lambda p: sum(scores[i] * p[i] for i in range(n)) + sum(step[p[i], p[i + 1]] for i in range(n - 1))  # noqa: E731, B023
        assert abs(value([int(x) for x in path]) - max(map(value, itertools.product((0, 1), repeat=n)))) < 1e-9


# --- 5, 6: tokens ---


def test_escape_is_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "s", ">", "/", "\\", "[", "INST", "]", *chat.CONTROL, "é"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)


def test_chat(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(1, 1, "assistant", "</s>[INST] é 😀"), (1, 0, "user", "\\<s>\\\\"), (2, 0, None, None), (None, 0, "assistant", ""), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), path).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\\<s>\\\\\nassistant\n</s>[INST] é 😀\n") and got[1]["loss_sha256"] == sha("</s>[INST] é 😀") and got[1]["loss_chars"] == 14
    assert got[2]["turns_sha256"] == sha("\n\n") and got[None]["loss_chars"] == 0 and got[3]["n_turns"] == 2 and got[3]["loss_sha256"] == sha("samesame")


def test_bpe_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, rng = tokenizers.Tokenizer.from_file(path), random.Random(0)
    texts = [t for t in HARD if t is not None] + ["<|endoftext|>x <|endof", "ΑΣ İ a\x1cb", "ab" * 2000, "!" * 1000, "it's 12'3"]
    texts += ["".join(rng.choice(rng.choice(["abcdefgh ", "etaoin shrdlu", "0123 !?.'", "éüñ漢字 ", "ΣΑ'sσ", "\x00\x1c\x85 <|>"])) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(rng.choice("abcdeinot") for _ in range(2000)), "the quick brown fox " * 30000, "x" * 40000 + " y"]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(50, 300))) for _ in range(40)]
    got = {r["doc_id"]: r for r in bpe.digests(frame(spark, [*texts, None]), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got[len(texts)]["n_tokens"] == 0


def test_bpe_emits_within_the_lookahead():
    """No token waits for more letters behind it than the lookahead, nor does a word without end fill the memory."""
    own, rng = bpe.loaded(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    for kind in range(40):
        letters, read = rng.choice(["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "0123456789", "!?.", "thequickbrown"]), 0

        def symbols(n=700):
            nonlocal read
            for i in range(n):
                read += 1
                yield (letters[i % len(letters)] if kind % 3 == 0 else rng.choice(letters)) + ("</w>" if i == n - 1 else "")

        end = 0
        for k in own.transduce(symbols(), step=1):
            end += own.length[own.surface[k]]
            assert read == 700 or read - end <= own.lookahead
        assert end == 700
    first = next(own.transduce(itertools.cycle("thequickbrown")))
    assert first == own.vocab["the"]
    assert "".join(own.words_of(own.encode("Hello, wörld"))) == "hello , wörld "


def plain_bpe(symbols, rank):
    while True:
        best = min(((rank[p], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in rank), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


def test_bpe_sufficient_lookahead_of_any_merge_list(tmp_path):
    """Tokens that end the lookahead before a beginning's end stay, whatever follows; emission by it gives the plain encoding."""
    rng, reached = random.Random(5), 0
    pattern = {"type": "Split", "pattern": {"Regex": "[^\\s]+"}}
    for n in range(60):
        tokens, merges = list("ab"), []
        for _ in range(rng.randrange(1, 8)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens:
                tokens.append("".join(pair))
                merges.append(list(pair))
        vocab = {t: i for i, t in enumerate([*tokens, "a</w>", "b</w>"])}
        (tmp_path / f"{n}.json").write_text(json.dumps({"model": {"end_of_word_suffix": "</w>", "vocab": vocab, "merges": merges}, "added_tokens": [], "pre_tokenizer": {"pretokenizers": [pattern]}}))
        own = bpe.Bpe(str(tmp_path / f"{n}.json"))
        for _ in range(60):
            word = [rng.choice("ab") for _ in range(30)]
            symbols = [*word[:-1], word[-1] + "</w>"]
            whole = plain_bpe(symbols, own.rank)
            assert [own.surface[i] for i in own.transduce(symbols, step=1)] == whole
            ends = set(itertools.accumulate(own.length[t] for t in whole))
            for k in range(1, 30):
                of_prefix = list(itertools.accumulate(len(t) for t in plain_bpe(word[:k], own.rank)))
                kept = max((e for j, e in enumerate(of_prefix) if set(of_prefix[: j + 1]) <= ends), default=0)
                lost = [e for e in of_prefix if e > kept]
                assert not lost or lost[0] > k - own.lookahead
                reached += bool(lost) and lost[0] == k - own.lookahead + 1
    assert reached
    (tmp_path / "bad.json").write_text(json.dumps({"model": {"end_of_word_suffix": "</w>", "vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "merges": [["ab", "a"], ["a", "b"]]}, "added_tokens": [], "pre_tokenizer": {"pretokenizers": [pattern]}}))
    with pytest.raises(ValueError):
        bpe.Bpe(str(tmp_path / "bad.json"))


def test_bpe_reads_texts_in_pieces(monkeypatch):
    """Texts cut into pieces anywhere give the library's ids, and a longer text takes no more memory."""
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, rng = tokenizers.Tokenizer.from_file(path), bpe.loaded(path), random.Random(6)
    texts = ["!" * 40 + "'s" + "e\u0301\u0323" * 9 + "'re", "ㄱ가각" + "\u1100\u1161\u11a8" * 12, "x" * 50 + "123 <|endoftext|>" + "'" * 33 + "ll"]
    texts += ["".join(rng.choice(["a", "the", "'s", "'", "!", "1", "e\u0301", "\u0323\u0301", "\u1100", "\u1161\u11a8", "Å", "Σ", "漢", "😀", " " if n % 2 else "z"]) for _ in range(rng.randrange(200))) for n in range(300)]
    for size in (1, 3, 20):
        monkeypatch.setattr(bpe, "READ", size)
        for t in texts:
            assert np.frombuffer(b"".join(own.encode(t)), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, (size, t)
    monkeypatch.setattr(bpe, "READ", 1 << 12)
    monkeypatch.setattr(bpe, "PIECE", 1 << 10)
    for unit in ("some plain words here, ", "thequickbrownfox", "12'3"):
        peaks = []
        for letters in (40_000, 400_000):
            text = unit * (letters // len(unit))
            bpe.digest(own, text[:20_000])
            tracemalloc.start()
            bpe.digest(own, text)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        assert peaks[1] < 1.3 * peaks[0] + 50_000, (unit, peaks)


def test_bpe_reads_a_word_once(monkeypatch):
    """A word is encoded once, whatever marks stand behind it; one that comes often is not forgotten among many others."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    words = ["".join(rng.choices(["the", "an", "er", "tion", "st", "ou", "ción", "sch", "é"], k=4)) for _ in range(1000)]
    text, calls = " ".join(w + mark for w in words for mark in ("", ",", ".", "!!")), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    own = bpe.Bpe(path)
    sys.setprofile(count)
    try:
        ids = b"".join(own.encode(text))
    finally:
        sys.setprofile(None)
    assert calls < 60 * len(words), calls / len(words)
    assert b"".join(struct.pack("<I", i) for w in text.split() for part in own.pattern.findall(w) for i in own.word(part)) == ids

    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own, seen = bpe.Bpe(path), []

    class Pattern:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, chunk):
            seen.append(chunk)
            return self.pattern.findall(chunk)

    own.pattern = Pattern(own.pattern)
    assert b"".join(own.encode(text)) == ids
    seen.clear()
    b"".join(own.encode(" ".join(f"often {w}" for w in words)))
    assert seen.count("often") == 1


# --- 7: top-k ---


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_topk_against_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(700, 8)) * scale).round(3)
    v[5:60] = v[5]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1100, [1.0, None] + [0.0] * 6), (1200, [float("nan")] * 8), (None, [1.0] * 8), (1301, [20.0 * scale]), (1302, [])]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    w = [[int(x) for x in np.floor(r * 1024)] for r in v]
    assert sorted(got) == list(range(0, 700, 100))
    for q in got:
        others = [(j, w[j]) for j in range(700) if j != q] + [(1301, [int(20480 * scale)]), (1302, [])]
        best = sorted((-sum(a * b for a, b in zip(w[q], x)), j) for j, x in others)[:10]
        assert got[q] == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_topk_of_hard_tables(spark):
    find = lambda rows: [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int, least int"), F.col("vec_id") % 100 == 0, 2).orderBy("query_id", "rank").collect()]
    extra = ("mine", 5, 7)
    assert find([(None, None, *extra)]) == [] and find([(0, [1.0], *extra)]) == []
    # Fewer candidates than wanted, ties, repeated rows, and another row of a query's id, which is none of its candidates.
    rows = [(0, [1.0, 0.5], *extra)] * 2 + [(1, [1.0, 0.0], *extra), (2, [1.0, 0.0], *extra), (100, [0.0, -1.0], *extra)]
    one = 1024
    assert find(rows) == [(0, 1, 1, one * one), (0, 2, 2, one * one), (100, 1, 1, 0), (100, 2, 2, 0)]
    assert find([(0, [-1e-9], *extra), (5, [3e-3], *extra)]) == [(0, 1, 5, -3)]
    # A score beyond 64 bits is the last number that fits, and takes no other query's rows with it.
    most = (1 << 63) - 1
    rows = [(0, [1e300, 1.0], *extra), (1, [1.0], *extra), (2, [-1e300], *extra), (3, [0.0, 2.0], *extra), (100, [1e10, 1.0], *extra), (4, [1e8], *extra), (200, [1.0, 1.0], *extra)]
    want = {0: [(1, most), (4, most)], 100: [(0, most), (4, most)], 200: [(0, most), (100, int(1e10) * one * one + one * one)]}
    assert find(rows) == [(q, k + 1, *x) for q, found in want.items() for k, x in enumerate(found)]


def test_topk_of_one_long_vector(spark):
    """5000 short vectors and one of 20,000 components: every block is as wide as its own longest vector."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(5000, 8))
    long_ = rng.normal(size=20_000)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(10_000, long_.tolist())]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 1000 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: np.floor(1024 * np.array(x)).astype(np.int64) for i, x in rows}
    for q in (0, 1000, 2000, 3000, 4000, 10_000):
        best = sorted((-int(whole[q][:8] @ x[:8]), i) for i, x in whole.items() if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in best]


# --- 9: packing ---


def test_best_bounds_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, buckets = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        longest, count = np.sort(rng.choice(50, n, replace=False)) + 1, rng.integers(1, 9, n)
        cost = lambda bounds: sum(int(c) * min(b for b in bounds if b >= x) for x, c in zip(longest, count))  # noqa: E731, B023
        best = min(cost((*s, longest[-1])) for k in range(min(buckets, n)) for s in itertools.combinations(longest[:-1].tolist(), k))
        got = packing.best_bounds(longest.tolist(), count.tolist(), buckets)
        assert len(got) <= buckets and cost(got) == best


def test_packing(spark):
    rng = random.Random(6)
    texts = HARD + [prose(rng, rng.randrange(1, 900)) for _ in range(300)]
    rows = packing.pack(frame(spark, texts), buckets=5, budget=2000).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    batches = collections.defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == len(words(texts[r["doc_id"]]))
        if r["n_tokens"]:
            assert r["n_tokens"] <= r["bucket_len"]
            batches[r["batch_id"]].append(r)
        else:
            assert r["batch_id"] is None and r["bucket_len"] is None
    assert len({r["bucket_len"] for r in rows} - {None}) <= 5
    for b in batches.values():
        assert sorted(r["place"] for r in b) == list(range(len(b))) and (len(b) == 1 or len(b) * b[0]["bucket_len"] <= 2000)
    assert packing.pack(frame(spark, [None, ""])).where("batch_id is null").count() == 2 and packing.pack(frame(spark, [])).count() == 0


# --- 10: near duplicates ---


def classes_of(texts, percent=75):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = words((t or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return [len(s) for s in sets], label


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_join_against_brute_force(spark):
    rng = random.Random(7)
    passage = prose(rng, 70, 10**6)
    texts = list(HARD) + ["A b C d e", "a B c D E", "a b c d e f"]
    for _ in range(40):  # chains and groups of near copies around the threshold
        one = prose(rng, rng.choice([5, 8, 12, 20, 60, 150, 400]), 10**6)
        texts += [one] + [edited(rng, one, rng.randrange(1, max(2, len(one.split()) // 25))) for _ in range(rng.randrange(4))]
    texts += [passage + " " + prose(rng, rng.randrange(5, 40), 10**6) for _ in range(60)]  # one passage in many texts
    hub = prose(rng, 120, 10**6)
    texts += [edited(rng, hub, rng.randrange(1, 5)) for _ in range(80)] + [hub] * 30  # a large group
    rng.shuffle(texts)
    sizes, label = classes_of(texts)
    rows = {r["doc_id"]: r for r in ngram_join.near_duplicates(frame(spark, texts).repartition(5)).collect()}
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [rows[i]["component_id"] for i in range(len(texts))] == label
    kept = ngram_join.first_of_each(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if label[i] == i]


def test_join_with_ids_that_are_no_keys(spark):
    """Ids may be null or repeated, with equal texts or others; every row counts for itself."""
    rng = random.Random(17)
    one, other, third, lone = (prose(rng, 60, 10**6) for _ in range(4))
    rows = [(1, one), (1, other), (2, one + " more"), (None, other + " more"), (9, other + " and"), (None, third), (None, third + " more"), (4, lone), (4, lone), (4, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs.repartition(3)).collect()), key=str)
    want = [(1, 56, 1), (1, 56, 1), (2, 57, 1), (None, 57, 1), (9, 57, 1), (None, 56, None), (None, 57, None), (4, 56, 4), (4, 56, 4), (4, 0, 4), (None, 0, None)]
    assert got == sorted(want, key=str)
    kept = sorted(r["n_chars"] for r in ngram_join.first_of_each(docs).collect())
    # The first of each component (the second text's component has id 1 as well), and the rows without words.
    assert kept[:2] == [0, 1] and kept[2] in (5, 6) and kept[3] in (7, 8) and kept[4:] == [9, 10]


def test_join_of_large_groups_with_unlike_slack(spark):
    """Hundreds of texts share passages in texts of several sizes, so that some have too few signatures elsewhere and others enough."""
    rng = random.Random(18)
    passages = [prose(rng, n, 10**6) for n in (60, 90, 120)]
    texts = []
    for k in range(150):
        own = f"{passages[k % 3]} {prose(rng, rng.choice([12, 18, 26, 40]), 10**6)}"
        texts += [own] + ([own + " " + prose(rng, rng.randrange(1, 30), 10**6)] if k % 2 else [])
    rng.shuffle(texts)
    sizes, label = classes_of(texts)
    rows = {r["doc_id"]: r for r in ngram_join.near_duplicates(frame(spark, texts).repartition(5)).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == label and [rows[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_messages_of_signatures(monkeypatch):
    """What is sent in few or many parts, and told of large groups on the way, groups alike."""
    rng = np.random.default_rng(5)
    sigs = [np.unique(np.concatenate([rng.integers(0, 1 << 63, 40, dtype=np.uint64), np.arange(3, dtype=np.uint64) << np.uint64(61 - k % 2)])) for k in range(60)]
    found = []
    for parts, most in ((1, 60), (7, 60), (500, 60), (7, 9)):
        told = collections.defaultdict(list)
        for a in range(0, 60, most):
            for m in ngram_join._posted(sigs[a : a + most], list(range(a, min(a + most, 60))), parts):
                told[m.column("part")[0].as_py()].append(m)
        rows = [r for part in told.values() for b in ngram_join._group(iter(part)) for r in b.to_pylist()]
        found.append({r["a"] for r in rows if r["kind"] == "common"})
        ends = collections.defaultdict(set)
        for r in rows:
            if r["kind"] == "pair":
                ends[r["a"]].add(r["b"])
                ends[r["b"]].add(r["a"])
        assert len(ends) == 60
    assert all(f == set(range(60)) for f in found)


def test_signatures_meet_whenever_sets_are_similar():
    """The pigeonhole for sets of every small size, with no help of heads or hubs."""
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 200, 700]:
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(4):
            most = ngram_join.most_different(n, n, 75)
            gone = int(rng.integers(0, most // 2 + 1))
            new = int(rng.integers(0, most - gone + 1))
            other = np.unique(np.concatenate([own[rng.permutation(n)[gone:]], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            both = len(np.intersect1d(own, other))
            if 100 * both >= 75 * (len(own) + len(other) - both):
                a, b = ngram_join.signatures(own, 75)[0], ngram_join.signatures(other, 75)[0]
                assert len(np.intersect1d(a, b)), n
                assert ngram_join.sketch_distance(ngram_join.sketch(own), ngram_join.sketch(other, 2)) <= len(own) + len(other) - 2 * both


def test_join_of_nothing(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    rows = ngram_join.near_duplicates(spark.createDataFrame([(None, "a b c d e", "", "", 0), (4, "a b c d e", "", "", 0), (None, None, "", "", 0)], DOCS)).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in rows if r["n_shingles"]) == [(1, 4), (1, 4)]


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    label = {x: x for ab in links for x in ab}
    for _ in range(len(links)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: label[n] for n in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    good = [prose(rng, rng.randrange(30, 150)) for _ in range(250)]
    bad = [" ".join(w + "&&&" for w in prose(rng, 60).split()) for _ in range(30)]
    texts = good + bad + [edited(rng, good[0], 1), good[1], "mail me " + good[2] + " now x@y.zz", None, ""]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 250), 0) for i in range(280)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
    ids = {r["doc_id"] for r in docs.collect()}
    assert not any("@" in r["text"] for r in docs.collect()) and not ids & set(range(250, 280))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids
