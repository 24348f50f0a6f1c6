"""Language, quality, toxicity and secrets on small tables."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import language, quality, queries, secrets, toxicity
from tests.llm.rows import PROSE, awkward, documents, empty, write

EN = ["the cat sat on the mat and the dog was with them in the house", "this is what they said when the rain had stopped for the day", "there are many things that we want to do with the others"]
DE = ["der hund und die katze sind nicht in dem haus bei uns", "das ist was sie gesagt haben als der regen aufgehört hatte", "es gibt viele dinge die wir mit den anderen machen wollen"]


def labelled(spark):
    texts = [" ".join(random.Random(i).sample(EN, 2)) for i in range(20)] + [" ".join(random.Random(i).sample(DE, 2)) for i in range(20)]
    return documents(spark, texts, lang=["en"] * 20 + ["de"] * 20)


def test_language_of_unseen_texts(spark):
    model = language.fit(labelled(spark))
    out = {r["doc_id"]: r for r in language.identify(documents(spark, ["the dog and the cat are in the house", "die anderen haben das haus nicht", None, "", "12 34 !!", "漢字漢字漢字"]), model).collect()}
    assert [out[i]["lang_nearest"] for i in (1, 2, 3, 4, 5)] == ["en", "de", None, None, None]
    assert [out[i]["lang_pred"] for i in (3, 4, 5, 6)] == ["und"] * 4  # the last one is rejected for its distance
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_edges(spark):
    model = language.fit(labelled(spark))
    assert language.identify(awkward(spark), model).count() == 9
    assert language.identify(empty(spark), model).count() == 0
    nothing = language.fit(empty(spark))
    assert {r["lang_pred"] for r in language.identify(awkward(spark), nothing).collect()} == {"und"}


def test_quality_prefers_the_target(spark):
    good = documents(spark, [PROSE * 3] * 4)
    mixed = documents(spark, [PROSE * 2, "%%% ### $$$ &&& " * 20, PROSE, "| | | | | |" * 9])
    out = {r["doc_id"]: r for r in quality.resample(mixed, good, scale=100.0).collect()}
    assert [out[i]["selected"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert out[1]["score"] > 0.5 > out[2]["score"]


def test_quality_edges(spark):
    out = quality.resample(awkward(spark), documents(spark, [PROSE])).collect()
    assert len(out) == 9 and sum(r["selected"] for r in out) in (4, 5)
    assert all(r["log_weight"] == 0 for r in out if r["doc_id"] in (2, 3, 7))
    assert quality.resample(empty(spark), empty(spark)).count() == 0


def test_gumbel_ranks_follow_importance(spark):
    """Without noise to speak of the sample is the brute-force order of the weights."""
    docs = documents(spark, [PROSE[:40 + 9 * i] + "%% " * (7 * i % 20) for i in range(30)])
    out = quality.resample(docs, documents(spark, [PROSE]), scale=1e6).collect()
    best = sorted(out, key=lambda r: -r["log_weight"])
    assert {r["doc_id"] for r in out if r["selected"]} == {r["doc_id"] for r in best[:15]}


def test_quality_counts_every_labelled_text(spark, tmp_path):
    """More good labels than one small sample holds, also sent in several parts."""
    docs = spark.range(36_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 977, F.lit(" and "), F.col("id") % 1_009).alias("text"))
    write(docs, tmp_path, "documents")
    write(docs.select("doc_id", F.lit(1).alias("quality")), tmp_path, "labels")
    good = docs.where(queries.fold(3) != 1)
    assert good.count() > 20_000
    want = quality.log_ratios(good, docs)
    parts = quality.listed(docs, good.select("doc_id"), most=7_000)
    assert len(parts) == -(-good.count() // 7_000) and (quality.log_ratios(parts, docs) == want).all()
    assert (quality.log_ratios(quality.listed(docs, good.limit(0)), docs) == quality.log_ratios(good.limit(0), docs)).all()
    out = queries.op2_quality(spark, str(tmp_path)).select("doc_id", "log_weight")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in quality.weigh(docs, want, keep=["doc_id"]).collect()}


LEXICON = toxicity.Lexicon({"idiot": 0.99, "disgusting": 0.98}, {"lowei": 0.99}, base=0.01)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_plain_edit_distance():
    matcher = toxicity.Matcher(LEXICON)
    rng = random.Random(3)
    for _ in range(4000):
        word = list(rng.choice(["idiot", "disgusting", "lowei", "loweischaft", "hello"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["", "x", "i"])
        word = "".join(word)
        found = matcher.search(word)
        want = [distance(word, t) for t in LEXICON.terms if distance(word, t) <= toxicity.allowed(len(t))]
        want += [d for d in [min(distance(word[:n], "lowei") for n in range(len(word) + 1))] if d <= 1]
        assert (found is not None) == bool(want and len(word) >= 4), word


def test_quotation_and_abuse(spark):
    docs = documents(spark, ["you are an idiot", "you are an id1iot and idjot", 'he wrote "idiot" in the report', "Loweischaft!", "fine words", None, "", "you are disgustinq"])
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, LEXICON).collect()}
    assert out[1] > 0.9 and out[2] > 0.7 and out[4] > 0.9 and out[8] > 0.7
    assert out[3] < 0.7 and out[5] == out[6] == out[7] == LEXICON.base


def test_words_disguised_by_digits_and_signs(spark):
    lexicon = toxicity.Lexicon({"idiot": 0.99, "stupid": 0.98, "moron": 0.99, "scum": 0.97, "git": 0.96}, {}, base=0.01)
    bad = ["id1ot", "st0pid", "m*ron", "i.d.i.o.t", "s-t-u-p-i-d", "a total-id1ot", "sc*m", "git", "m**ron"]
    fine = ["more-on that", "it's digital", "gift", "id 1 ot", "mp3s and b2b", "scam", "sc-m"]
    out = [r["toxicity"] for r in toxicity.score_toxicity(documents(spark, bad + fine), lexicon).orderBy("doc_id").collect()]
    assert [s > 0.7 for s in out] == [True] * len(bad) + [False] * len(fine)
    assert set(out[len(bad):]) == {lexicon.base}
    spans = toxicity.score_toxicity(documents(spark, ["you total-id1ot, you"]), lexicon, spans="at").first()["at"]
    assert [(r["start"], r["end"], r["distance"]) for r in spans] == [(10, 15, 1)]


def test_terms_of_three_letters_are_learned(spark):
    docs = documents(spark, [f"{PROSE[i:i + 60]} you git {i}" for i in range(30)] + [PROSE[i:i + 80] for i in range(60)])
    assert "git" in toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") <= 30).cast("int").alias("toxic"))).terms


def test_toxicity_learns_and_survives_edges(spark):
    bad = [f"{PROSE[i:i + 60]} you total moron {i}" for i in range(30)]
    fine = [PROSE[i:i + 80] for i in range(60)]
    docs = documents(spark, bad + fine)
    labels = docs.select("doc_id", (F.col("doc_id") <= 30).cast("int").alias("toxic"))
    lexicon = toxicity.fit(docs, labels)
    assert "moron" in lexicon.terms and len(lexicon.terms) + len(lexicon.stems) <= 4
    scored = toxicity.score_toxicity(awkward(spark), lexicon, score="score", spans="secrets")
    assert scored.count() == 9 and dict(scored.dtypes)["score"] == "double"
    assert toxicity.fit(empty(spark), labels.limit(0)) == toxicity.Lexicon({}, {})
    assert toxicity.fit(docs, labels.where("toxic = 0")) == toxicity.Lexicon({}, {})
    assert toxicity.score_toxicity(empty(spark), lexicon).count() == 0


def crc_token(body):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    return body + digits


def test_base_spans_equal_the_bare_patterns(spark):
    rng = random.Random(11)
    bits = ["password", "PassWD", "api_key", "apikey", "token", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "abcdefgh", "0123456789abcdef" * 2, "İ", "ſ", "K", "-", "\n", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "x" * 300_000 + " token=abcdefgh12"]
    out = secrets.scan_secrets(documents(spark, texts)).select("doc_id", *secrets.digest()).collect()
    for r in out:
        assert tuple(r)[1:5] == secrets.brute_digest(texts[r["doc_id"] - 1]), texts[r["doc_id"] - 1]


def test_checksums_decide(spark):
    good = "ghp_" + crc_token("a" * 30)
    card, wrong = "card: 4111 1111 1111 1111", "card: 4111 1111 1111 1112"
    docs = documents(spark, [f"x {good} y", f"x {good[:-1]}! y", card, wrong, "IBAN: GB82 WEST 1234 5698 7654 32", "IBAN: GB83 WEST 1234 5698 7654 32"])
    out = {r["doc_id"]: r for r in secrets.scan_secrets(docs, clean="clean").collect()}
    assert [[s["kind"] for s in out[i]["secrets"]] for i in range(1, 7)] == [["github"], [], ["card"], [], ["iban"], []]
    assert out[1]["clean"] == "x [SECRET] y" and out[2]["clean"] == out[2]["text"]


def test_redaction_joins_overlapping_spans():
    assert secrets.redacted("abcdefgh", [(1, 0, 4), (2, 1, 6)], "*") == "a*gh"
    assert secrets.redacted("abcdefgh", [(0, 0, 2), (4, 0, 8)], "*") == "*cd*"


@pytest.mark.parametrize("table", [awkward, empty])
def test_secret_scan_keeps_rows(spark, table):
    df = table(spark)
    assert secrets.scan_secrets(df).count() == df.count()


def test_toxicity_branches_end_at_the_edits_their_entries_allow():
    """Matches are those of plain edit distances; a branch of short entries is left after one edit, and clean words are looked up once."""
    import random

    from paperloom.llm.toxicity import Lexicon, Matcher, allowed

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        return row[-1]

    rnd = random.Random(4)
    terms = {"abcba": 0.9, "ccab": 0.8, "abcabcabca": 0.7, "bacca": 0.6}
    words = {"".join(rnd.choices("abc", k=rnd.randint(3, 11))) for _ in range(3000)} | set(terms)
    matcher = Matcher(Lexicon(terms, {}))
    assert matcher.matching(words) == {w for w in words if any(edits(w, t) <= allowed(len(t)) for t in terms)}
    calls, matcher.search = [], lambda w, plain=matcher.search: calls.append(w) or plain(w)
    assert matcher.matching(words) == set(calls)
    assert matcher.trie["c"][0] == 0 and matcher.trie["b"][0] == 1 and matcher.trie["a"][0] == 2
