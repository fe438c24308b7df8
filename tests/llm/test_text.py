"""Toxicity, language, personal data, token counts and packing."""

import math
import random
import re
import time
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language, packing, pii, queries, tokens, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def texts_of(spark, n=80):
    return [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(n).collect()]


# Toxicity


def test_folding_sees_through_disguises():
    assert toxicity.fold("Ｉd1оt! 2024 a$$ b4d") == ["idiot", "2024", "ass", "bad"]
    assert toxicity.fold(None) == toxicity.fold("") == []


def test_exceptions_and_the_largest_weight_at_a_word():
    lex = toxicity.Lexicon({" trash": 2.0, " trashy ": 3.0}).build()
    assert lex.matched("the trash can is full".split()) == []
    assert lex.matched("trashy trash".split()) == [3.0, 2.0]


@pytest.mark.parametrize("text", ["1oser", "c1own", "a |oser", "!diot", "id!ot", "lo\xadser", "c\u200blo\u200bwn", "6astard", "bi9ot", "hello!loser", "you\u200bloser", "l0ser!"])
def test_every_reading_of_a_disguise_matches(text):
    lex = toxicity.Lexicon({" loser": 2.0, " clown ": 2.0, " idiot ": 2.0, " bastard ": 2.0, " bigot ": 2.0}).build()
    assert lex.matched(*toxicity.read(text)) == [2.0]


@pytest.mark.parametrize("text", ["ioser", "ciown", "1619 111", "gastard", "foo! bar", "class c1own", "class c!own", "| a | b |"])
def test_other_words_do_not_match(text):
    lex = toxicity.Lexicon({" loser": 2.0, " clown ": 2.0, " ill ": 2.0, " bastard ": 2.0, " fool ": 2.0}).build()
    assert lex.matched(*toxicity.read(text)) == []


def test_a_disguise_teaches_all_its_readings():
    assert {" loser ", " ioser ", " lose", " iose"} <= toxicity.features(toxicity.read("1oser")[0])


def test_toxicity_on_rows_that_were_held_out(spark):
    found = queries.op1_toxicity(spark, "/root/testdata/sf0.01").alias("f")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.9


def test_support_follows_the_number_of_labels(spark):
    """Four toxic rows teach a word where there are few candidates; where there are many, chance would give as much."""
    few = frame(spark, ["you grobnik"] * 4 + ["calm words"] * 40)
    learned = toxicity.fit(few, few.select("doc_id", (F.col("doc_id") < 4).cast("int").alias("toxic")))
    assert " grobnik " in learned.weights and learned.build().score("that grobnik") > learned.score("calm words")
    many = frame(spark, [f"you {'grobnik' if k < 4 else ''} " + " ".join(f"word{k}x{j}" for j in range(900)) for k in range(44)])
    learned = toxicity.fit(many, many.select("doc_id", (F.col("doc_id") < 22).cast("int").alias("toxic")))
    assert " grobnik " not in learned.weights
    assert queries.op1_toxicity(spark, "/root/testdata/sf0.001").select("score").distinct().count() > 1


def test_toxicity_without_labels_or_texts(spark):
    docs = frame(spark, ["fine", "", None])
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    scores = [r[0] for r in docs.select(toxicity.score(docs, empty, F.col("text"))).collect()]
    assert len(set(scores)) == 1 and 0 <= scores[0] < 0.7
    assert docs.filter("false").select(toxicity.score(docs, empty, F.col("text"))).count() == 0


def test_a_learned_word_scores_high(spark):
    docs = frame(spark, ["a calm text about things", "you grobnik person go away"] * 60)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    lex = toxicity.fit(docs, labels.withColumn("text", F.lit("clash")))
    tests = frame(spark, ["gr0bnik", "a calm text", "the grоbnik " + "word " * 200_000])
    high, low, _ = (r[0] for r in tests.orderBy("doc_id").select(toxicity.score(docs, lex, F.col("text"))).collect())
    assert high > 0.7 > low


def naive_hits(text, weights, exceptions):
    """Weights by place, with a loop over all entries and places; the text has no open signs."""
    text = f" {' '.join(toxicity.fold(text))} "
    spared = [(k, k + len(e) + 1) for e in exceptions for k in range(len(text)) if text.startswith(f" {e} ", k)]
    best = {}
    for entry, weight in weights.items():
        for k in range(len(text)):
            if text.startswith(entry, k) and not any(a <= k < b for a, b in spared):
                best[k] = max(best.get(k, 0), weight)
    return best


def test_scores_are_those_of_a_plain_scan(spark):
    rng = random.Random(8)
    words = ["trash", "trashy", "can", "moron", "the", "m0ron", "dull", "dullard", "bin", "a"]
    weights, exceptions = {" trash": 2.0, " trash ": 2.5, " moron ": 3.0, " dull": 1.0, " dullard ": 4.0}, ("trash can", "can trash", "the dull bin", "moron moron")
    lex = toxicity.Lexicon(weights, exceptions, (-2.0, 1.0, 0.5, 0.25)).build()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    docs = frame(spark, texts)
    got = [r[0] for r in docs.orderBy("doc_id").select(toxicity.score(docs, lex, F.col("text"))).collect()]
    for text, score in zip(texts, got, strict=True):
        total = sum(naive_hits(text, weights, exceptions).values())
        n = len(toxicity.fold(text))
        z = -2.0 + (total > 0) + 0.5 * math.log1p(total) + 0.25 * math.log1p(100 * total / max(20, n))
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-12


def test_exceptions_are_learned_from_pairs_of_other_rows(spark):
    texts = ["you grobnik go away"] * 40 + ["the grobnik valley is a fine place"] * 6 + ["a calm text about things"] * 300
    docs = frame(spark, texts).withColumns({c: F.lit("clash") for c in ("_id", "_label", "_did", "_text", "toxic", "other", "entry", "odds")})
    labels = docs.select("doc_id", (F.col("doc_id") < 40).cast("int").alias("toxic"), F.lit(1).alias("_id"), F.lit("clash").alias("text"))
    lex = toxicity.fit(docs, labels)
    assert {"the grobnik", "grobnik valley"} <= set(lex.exceptions) and "you grobnik" not in lex.exceptions
    score = lex.build().score
    assert score("that grobnik again") > 0.5 > 0.1 > score("near the grobnik valley")


def seconds(call):
    start = time.perf_counter()
    call()
    return time.perf_counter() - start


def test_scans_take_linear_time():
    lex = toxicity.Lexicon({" trash": 2.0, " moron": 2.0}).build()
    for call, text in ((lex.score, "moron trash can "), (pii.find, "a@b.co x [at] y.com \n")):
        call(text * 10)
        short, long = min(seconds(lambda: call(text * 4_000)) for _ in range(3)), min(seconds(lambda: call(text * 16_000)) for _ in range(3))
        assert long < 8 * short


# Language


def naive_likelihood(word, pieces, n):
    """The sum over all segmentations, listed one by one."""
    text = language.START + word

    def cut(rest):
        if not rest:
            yield (1.0,) * n
        for j in range(1, min(len(rest), language.LONGEST_PIECE) + 1):
            p = pieces.get(rest[:j]) or ((language.UNKNOWN,) * n if j == 1 else None)
            if p:
                for tail in cut(rest[j:]):
                    yield tuple(a * b for a, b in zip(p, tail, strict=True))

    return [math.fsum(x) for x in zip(*cut(text), strict=True)]


def test_predictions_are_those_of_listed_segmentations(spark):
    rng = random.Random(9)
    pieces = {p: (rng.random() / 10, rng.random() / 10) for p in ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁b", "ca", "cab"]}
    model = language.Model(["x", "y"], [0.3, 0.7], pieces)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 6))) for _ in range(200)]
    docs = frame(spark, texts).withColumns({"lang": F.lit("clash"), "score": F.lit("clash")})
    got = [r[0] for r in docs.orderBy("doc_id").select(language.predict(docs, model, F.col("text"))).collect()]
    for text, (lang, score) in zip(texts, got, strict=True):
        total = [math.log(q) + sum(math.log(naive_likelihood(w, pieces, 2)[k]) for w in text.split()) for k, q in enumerate(model.prior)]
        best = max(range(2), key=lambda k: total[k])
        assert lang == model.langs[best] and abs(score - 1 / (1 + math.exp(min(total) - max(total)))) < 1e-9


@pytest.fixture(scope="module")
def pieces():
    return language.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_forward_sums_all_segmentations():
    model = language.Model(["x", "y"], [0.5, 0.5], {"▁a": (0.1, 0.2), "b": (0.3, 0.1), "▁ab": (0.05, 0.4), "▁": (0.2, 0.2), "a": (0.1, 0.1), "ab": (0.02, 0.3)})
    want = [0.1 * 0.3 + 0.05 + 0.2 * 0.1 * 0.3 + 0.2 * 0.02, 0.2 * 0.1 + 0.4 + 0.2 * 0.1 * 0.1 + 0.2 * 0.3]
    import numpy as np

    assert np.allclose(np.exp(model.word("ab")), want)
    assert np.allclose(np.exp(language.Scorer(model)._forward(["ab"], 3)[0]), want)


def test_long_words_do_not_underflow():
    import numpy as np

    model = language.Model(["x", "y"], [0.5, 0.5], {"▁": (0.1, 0.1), "a": (1e-5, 1e-6)})
    x, y = model.word("a" * 500)
    assert np.isfinite(x) and np.isfinite(y) and abs(x - 500 * np.log(1e-5) - np.log(0.1)) < 1e-6 and y < x - 100


def test_language_on_rows_that_were_held_out(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op2_language(spark, d).withColumnRenamed("score", "p")
    rows = found.join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und' AND n_chars > 100").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["p"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, pieces):
    rows = [(0, "the house is big", "en"), (1, "das Haus ist groß", "de"), (2, None, "en"), (3, "12 34", None), (4, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, pieces)
    got = [r[0] for r in docs.orderBy("doc_id").select(language.predict(docs, model, F.col("text"))["lang"]).collect()]
    assert got == ["en", "de", "und", "und", "und"]
    nothing = language.fit(docs.filter("false"), pieces)
    assert {r[0] for r in docs.select(language.predict(docs, nothing, F.col("text"))["lang"]).collect()} == {"und"}


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("text", ["a@b.c", "a@b@c.d", "x..y@h-.z.w more", "@a.b", "1.2.3.4.5.6.7.8", "001.2.3.255", "1.2.3.256", "4111 1111-1111 1111", "4111111111111111 4111111111111112", "+1 (555) 010-9999.", "+1+49 30 1234567", "--@a.b a@b.c@d.e", "é@b.c", "", "a@b", "１.2.3.4 ٣"])
def test_base_matches(text):
    assert [s[:3] for s in pii.find(text) if s[3]] == base(text)


def test_base_matches_of_documents(spark):
    for t in texts_of(spark):
        assert [s[:3] for s in pii.find(t) if s[3]] == base(t or "")


@pytest.mark.parametrize(
    ("text", "kind", "covered"),
    [
        ("mail to jane (at) host [dot] org now", "email", "jane (at) host [dot] org"),
        ("mail jane dot doe at host dot com today", "email", "jane dot doe at host dot com"),
        ("write jаne@hоst.org please", "email", "jаne@hоst.org"),
        ("server 10 dot 20 dot 30 dot 40 up", "ip", "10 dot 20 dot 30 dot 40"),
        ("call plus one five five five zero one zero nine nine nine nine now", "phone", "plus one five five five zero one zero nine nine nine nine"),
        ("pay ４１１１ 1111 1111 1111 now", "card", "４１１１ 1111 1111 1111"),
        ("at one nine two dot one six eight dot one dot one now", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_disguised_spans_map_back(text, kind, covered):
    found = [(s[0], text[s[1] : s[2]]) for s in pii.find(text) if not s[3]]
    assert (kind, covered) in found


@pytest.mark.parametrize(
    ("text", "covered"),
    [
        ("john at acme.com", "john at acme.com"),
        ("mail John.Doe at mail.acme.co.uk.", "John.Doe at mail.acme.co.uk"),
        ("john at acme dot xyz", "john at acme dot xyz"),
        ("ask mary at acme dot museum now", "mary at acme dot museum"),
        ("us at Acme dot Com", "us at Acme dot Com"),
        ("office at Acme.Com", "office at Acme.Com"),
        ("jane (dot) doe@host.org", "jane (dot) doe@host.org"),
        ("jane dot doe@host.org", "jane dot doe@host.org"),
        ("john @ acme . com", "john @ acme . com"),
        ("ask john@ mail.acme.com now", "john@ mail.acme.com"),
        ("john -at- acme -dot- com", "john -at- acme -dot- com"),
        ("john-at-acme-dot-co-dot-uk, ok", "john-at-acme-dot-co-dot-uk"),
        ("juan arroba acme punto com", "juan arroba acme punto com"),
        ("jean arobase acme.fr", "jean arobase acme.fr"),
        ("(john_at_acme_dot_com)", "john_at_acme_dot_com"),
        (" dot ".join("abcdefgh") + " at " + " dot ".join("ijklmnopqr") + " dot com", " dot ".join("abcdefgh") + " at " + " dot ".join("ijklmnopqr") + " dot com"),
    ],
)
def test_more_disguised_emails(text, covered):
    assert ("email", covered) in [(s[0], text[s[1] : s[2]]) for s in pii.find(text) if not s[3]]
    assert [s[:3] for s in pii.find(text) if s[3]] == base(text)


@pytest.mark.parametrize("text", ["look at example.com", "the shop at example.com is open", "we stayed at home.Then it rained", "open until 9 at example.com", "costs 3 at 20.50", "was sold at example.com"])
def test_addresses_of_sites_in_prose_are_no_personal_data(text):
    assert pii.find(text) == []


@pytest.mark.parametrize("text", ["meet me at noon dot", "look at this, one two three", "at home [at] the end", "costs 10 at 20", "meet @ noon . Then we go", "prices @ home . it was", "look_at_data.csv and polka-dot-dress", "see us @ acme.com", "three point one four one five nine"])
def test_prose_is_no_personal_data(text):
    assert pii.find(text) == []


def test_long_texts_take_linear_time(spark):
    dense = ("x_at_y_dot_", "a-dot-", "a arroba b punto ", "a @ b . ", "a dot ", "a at b.")
    text = "a" * 200_000 + "@ " + "1 " * 200_000 + "one " * 50_000 + "x at " * 50_000 + " ".join(d * 20_000 for d in dense)
    docs = frame(spark, [text, None, ""])
    assert [len(r[0]) for r in docs.orderBy("doc_id").select(pii.spans(F.col("text"))).collect()][1:] == [0, 0]


# Tokens


def test_token_counts_are_the_library_s(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", None, "Hello, WORLD's don't 12345", "naïve ÇA Σίσυφος ΟΔΟΣ", "日本語 text 中文", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "é é é ﬁ", "  x\ty\n\r z", "½ ² ٣ 4", "🙂🙃 ok", "x" * 5000, "İstanbul ǅ", "\x00\x1f​", "don’t ''s 's'S 'RE"]
    docs = frame(spark, odd + texts_of(spark))
    counted = docs.withColumn("n", tokens.token_counts(docs, "text", public_tokenizers.path("word_bpe_49k.json")))
    for r in counted.collect():
        assert r["n"] == len(lib.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]


def test_every_assigned_code_point_is_split_as_the_library_does():
    lib = tokens.Splitter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()).library
    for c in map(chr, range(1, 0x110000)):
        if "\ud800" <= c <= "\udfff" or not tokens.is_known(c):
            continue
        text = f"a{c}b {c}1"
        assert tokens.pre_tokens(text) == [w for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))], hex(ord(c))


def test_counts_of_code_points_that_python_does_not_know(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    new = [c for c in map(chr, range(1, 0x30000)) if not tokens.is_known(c)]
    texts = [f"a{c}b {c}1" for c in ["\ua7cb", "\ua7dc", *rng.sample(new, 3000)]]
    texts += ["".join(rng.choice(["a", "Σ", " ", "1", "\u0301", "<|endoftext|>", rng.choice(new), chr(rng.randrange(0x20, 0x3000))]) for _ in range(rng.randrange(40))) for _ in range(2000)]
    docs = frame(spark, texts).withColumn("n_tokens", F.lit("clash")).withColumn("word", F.lit("clash"))
    counted = docs.select("text", tokens.token_counts(docs, "text", public_tokenizers.path("word_bpe_49k.json")).alias("n")).collect()
    assert [r["n"] for r in counted] == [len(e.ids) for e in lib.encode_batch([r["text"] for r in counted], add_special_tokens=False)]


def test_the_table_of_frequent_words_is_bounded_and_of_an_empty_table_empty(spark):
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    words, lengths = tokens.frequent_lengths(frame(spark, ["b a a", "a b c", None, ""]), "text", spec, entries=2)
    assert words == "a\nb" and lengths.tolist() == [1, 1]
    empty = frame(spark, ["x"]).filter("false")
    assert len(tokens.frequent_lengths(empty, "text", spec)[1]) == 0
    assert empty.select(tokens.token_counts(empty, "text", public_tokenizers.path("word_bpe_49k.json"))).count() == 0


# Packing


def test_ids_are_the_library_s(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", None, "Hello  world\n\n x", "a<|endoftext|>b", "日本語 🙂 naïve", " lead", "x" * 9000, "\x00​ ", "don't I'LL 123 4567"]
    docs = frame(spark, odd + texts_of(spark))
    rows = defaultdict(list)
    for r in queries.gpt_pieces(docs).collect():
        rows[r["doc_id"]].append(r)
    for doc in docs.collect():
        ids = [*lib.encode(doc["text"] or "", add_special_tokens=False).ids, 2]
        own = sorted(rows[doc["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            assert r["length"] == 1024 or r["piece"] == 0


def check_packed(rows, capacity=1024):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_every_piece_is_packed_once(spark):
    pieces = spark.createDataFrame([(i % 50, i, 0, 1 + (i * 7919) % 1024, i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(7)
    rows = packing.pack(pieces).collect()
    assert sorted(r["ids_crc32"] for r in rows) == list(range(3000))
    total = sum(r["length"] for r in rows)
    assert check_packed(rows) <= -(-total // 1024) * 1.03


def test_underfull_bins_are_merged_round_by_round(spark):
    data = [(i, 0, 0, 120 + i % 5, i) for i in range(400)]  # about 48 bins by volume; 200 after the first round
    pieces = spark.createDataFrame(data, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(200)
    rows = packing.pack(pieces).collect()
    assert sorted(r["ids_crc32"] for r in rows) == list(range(400))
    assert check_packed(rows) <= 60
    assert max(r["sequence_id"] >> 56 for r in rows) >= 1  # the few small files of the first round make one partition


def test_packing_nothing_and_repeats(spark):
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, 0, 0, 512, 5)] * 4 + [(None, 0, 0, 1024, 6)], schema)).collect()
    assert len(rows) == 5 and check_packed(rows) == 3


def test_best_fit_prefers_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3], 10) == [[0, 2], [1, 3]]
    assert packing.best_fit([], 10) == []


def test_packing_documents(spark):
    rows = queries.op5_packing(spark, DATA).collect()
    total = sum(r["length"] for r in rows)
    assert check_packed(rows) <= -(-total // 1024) + 2
