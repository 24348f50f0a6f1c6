"""LaTeX, Markdown, quality, sections, archives and chunk packing on small fixtures."""

import random
import re

import pytest

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paperloom import kernels
from paperloom.functions import latex as lx
from paperloom.functions import text as tx
from paperloom.operators import chunking, containment, parsing, quality, sections
from paperloom.settings import ChunkSettings
from paperloom.sources import files


def one(spark, build, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(build(F.col("t"))).collect()]


def test_latex_clean_steps(spark):
    cases = {
        r"See \cite{a} and \ref{b}.": "See and .",
        r"\textbf{bold} \emph{it}": "bold it",
        r"\foo{\bar{deep}}": "deep",
        r"a---b--c": "a\u2014b\u2013c",
        r"``quote'' `x'": "\"quote\" 'x'",
        r"$x+y$ \(z\)": "x+y z",
        "one\n\n\n\ntwo": "one\ntwo",
        r"100\% sure": r"100\% sure",
        "": "",
    }
    assert one(spark, lx.clean, *cases) == list(cases.values())
    assert one(spark, lx.clean, None) == [""]


def test_titles_captions_equations(spark):
    assert one(spark, lx.section_title, r"3.1 \textbf{Related Work}:") == ["Related Work"]
    assert one(spark, lx.paper_title, "A % comment\n {Big} title --") == ["A Big title"]
    assert one(spark, lx.caption, "Figure 3: A plot", "Fig. 2. other") == ["A plot", "other"]
    assert one(spark, lx.equation, "\\begin{align*} a \\label{e}\n b \\end{align*}") == ["a b"]
    assert one(spark, lx.plain_text, r"x \begin{foo} gone \end{foo} \cmd[o]{arg} y") == ["x y"]
    assert one(spark, lambda c: lx.math_heavy(c), "$a$ b", "plain words here", "", " ") == [True, False, False, True]


def test_title_with_nested_braces_and_priority(spark):
    doc = r"\icmltitle{Second} \title{A {\bf {nested}} one} \begin{document}x\end{document}"
    assert one(spark, parsing.title, doc, r"\icmltitle{Only}", r"\title{never closed", "none") == ["A nested one", "Only", "", ""]


def test_equation_order_labels_and_context(spark):
    text = r"start $$ d $$ mid \begin{equation} e \label{x} \end{equation} and $long inline math here ok$ $s$"
    eqs = one(spark, lambda c: parsing.latex_equations(c), text)[0]
    assert [e["latex"] for e in eqs] == ["e", "d", "long inline math here ok"]
    assert eqs[0]["label"] == "x" and eqs[0]["context_before"] == "start $$ d $$ mid" and eqs[2]["is_inline"]


def contexts(text, pattern):
    """Every match with its surroundings, by places in the text."""
    found = []
    for m in re.finditer(pattern, text, re.S):
        before, after = text[max(0, m.start() - 200):m.start()].strip(), text[m.end():m.end() + 200].strip()
        found.append((m.group(1), before[-100:], after[:100]))
    return found


@pytest.mark.parametrize("count", [1, 60, 5000])
def test_equation_contexts_of_many_matches(spark, count):
    """Close and distant matches, separators of older formats inside the text, a match at either end."""
    rng = random.Random(count)
    text = "".join(f"$$ e{i} $$" + rng.choice(["", " ", "\u001e", "a\u001fb ", "word " * rng.randint(1, 90)]) for i in range(count)) + "$$ last $$"
    expected = [(" ".join(a.split()), b, c) for a, b, c in contexts(text, r"\$\$([^$]+)\$\$")]
    got = one(spark, lambda c: parsing.latex_equations(c, 0), text)[0]
    assert [(e["latex"], e["context_before"], e["context_after"]) for e in got] == expected


def test_inline_contexts_reach_over_many_short_matches(spark):
    spaced = "start " + "$x$ " * 150 + "$" + "y" * 30 + "$" + " $z$" * 150 + " end"
    got = one(spark, lambda c: parsing.latex_equations(c, 20), spaced)[0]
    before, after = spaced[:spaced.index("$y")], spaced[spaced.index("y$") + 2:]
    assert [(e["context_before"], e["context_after"]) for e in got] == [(before[-200:].strip()[-100:], after[:200].strip()[:100])]


def test_sections_keep_control_characters(spark):
    got = one(spark, parsing.latex_sections, "\\section{One}\n\nfirst\u001epart that is long\u001fenough here\n\\subsection*{Two}\n\nanother paragraph that is long enough", "none", None)
    assert [(s["order"], s["level"], s["title"], len(s["paragraphs"])) for s in got[0]] == [(1, 1, "One", 1), (2, 2, "Two", 1)]
    assert "\u001e" in got[0][0]["paragraphs"][0]["content"] and got[1] == [] and got[2] is None


def balanced(text):
    depth = 1
    for i, char in enumerate(text):
        depth += (char == "{") - (char == "}")
        if depth == 0:
            return text[:i]
    return None


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.text(alphabet="{}ab \u00e9", max_size=40), min_size=1, max_size=30))
def test_balanced_argument_equals_a_walk(spark, texts):
    assert one(spark, parsing.balanced_argument, *texts) == [balanced(t) for t in texts]


def test_parse_stays_in_the_jvm(spark):
    plan = parsing.parse_latex(spark.createDataFrame([("x",)], "content string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_tabular(spark):
    env = "\\begin{tabular}{l|l}a & b \\\\ 1 & \\textbf{2} \\\\ \\hline \\end{tabular}"
    assert one(spark, parsing.tabular_markdown, env, "none") == ["| a | b |\n| --- | --- |\n| 1 | 2 |", ""]


def test_markdown_document(spark):
    md = "# T\n\n## Abstract\nShort words.\n\n## 1 Intro\n\nA paragraph that is long enough.\n\n### Sub\n\n```x```\n\n$$ y $$\n\n![c](p.png)\n"
    df = parsing.counts(parsing.parse_markdown(spark.createDataFrame([("p", md)], "paper_id string, markdown string")))
    row = df.first()
    assert (row["title"], row["abstract"]) == ("T", "Short words.")
    assert [(s["title"], s["level"], len(s["paragraphs"])) for s in row["sections"]] == [("1 Intro", 1, 1), ("Sub", 2, 0)]
    assert row["equations"][0]["latex"] == "y" and row["figures"][0]["image"] == "p.png" and row["total_sections"] == 2


def test_section_filter_and_subtrees(spark):
    titles = ["References", "7. Acknowledgments", "Author  contributions", "Appendix B", "Method", ""]
    assert one(spark, sections.is_excluded, *titles) == [True, True, True, False, False, False]
    assert one(spark, sections.importance, " 1. Introduction", "Odd", "related  work") == [0.9, 0.7, 0.6]
    rows = spark.createDataFrame([("a", None, "Method"), ("b", None, "Appendix"), ("c", "b", "Proofs"), ("d", "c", "Lemma"), ("e", "a", "Sub")], "section_id string, parent_id string, title string")
    assert {r["section_id"] for r in sections.nested_excluded(rows).collect()} == {"a", "e"}


def test_quality(spark):
    bad = "broken \ufffd\ufffd text that is long enough to be judged by every single check here"
    run = "dots ............ " + "word " * 12
    report = quality.document_report(spark.createDataFrame([(1, bad), (2, run), (3, "#" * 60)], "id int, t string"), "id", "t")
    got = {r["id"]: r for r in report.collect()}
    assert not got[1]["passed"] and got[2]["passed"] and got[2]["special_runs"] == 1 and got[3]["low_alnum"] == 1
    assert one(spark, quality.fixed, "a\ufffd  b  ##### c\u0000") == ["a b   c"]
    assert one(spark, quality.is_valid, "w " * 10, "w " * 9, "\ufffd " + "w " * 10, "") == [True, False, False, False]


def test_archive_cycle_and_missing_include(spark):
    raw = kernels.pack_archive({"a/main.tex": r"\documentclass{x}\input{one}\input{one}\include{nope}", "a/one.tex": r"1\input{main}"})
    df = spark.createDataFrame([("p", bytearray(raw)), ("q", bytearray(b"junk"))], "paper_id string, content binary")
    got = {r["paper_id"]: r for r in files.resolve_archives(df).collect()}
    assert got["p"]["main_file"] == "a/main.tex" and got["p"]["content"].count("1") >= 1 and got["q"]["error"]


def test_keyword_file(spark):
    blocks = one(spark, files.keyword_blocks, "x\n* Hardware / low\nFPGA\nfpga\n\n* My Topic!\nfoo")[0]
    assert [(b["category"], b["keywords"]) for b in blocks] == [("hardware_systems", ["fpga"]), ("my_topic", ["foo"])]


def test_image_formats(spark):
    raw = [b"\x89PNG\r\n\x1a\nxx", b"\xff\xd8\xff", b"GIF89a", b"RIFF\x00\x00\x00\x00WEBP", b"%PDF-1", b"?"]
    df = spark.createDataFrame([(bytearray(r),) for r in raw], "c binary")
    assert [r[0] for r in df.select(files.image_format(F.col("c"))).collect()] == [".png", ".jpg", ".gif", ".webp", ".pdf", ".png"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60)), max_size=40))
def test_packing_invariants(raw):
    """Units appear in order, chunks stay within limit plus carry, sections do not mix."""
    units = sorted(raw)
    section, size = [u[0] for u in units], [u[1] for u in units]
    out = kernels.pack_document(section, [(0, i) for i in range(len(units))], size, 50, 10, 5)
    last = -1
    for c in out:
        assert c["first"] > last and len(set(section[c["first"] : c["last"] + 1])) == 1
        carried = min(10, size[c["carry"]]) if c["carry"] >= 0 else 0
        inside = sum(size[c["first"] : c["last"] + 1])
        assert inside <= 50 or c["first"] == c["last"]
        assert carried + inside <= 60 + max(0, inside - 50)
        last = c["last"]


def test_chunks_end_to_end(spark):
    words = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    sents = lambda n, k: " ".join(words(n - 1, f"s{j}x") + " end." for j in range(k))
    settings_ = ChunkSettings(max_tokens=50, overlap_tokens=10, min_tokens=10)
    data = [
        ("small", words(12), [("A", [words(5)]), ("B", [words(20), words(20)])], []),
        ("packed", "", [("A", [words(30, "a"), words(30, "b"), words(30, "c")])], []),
        ("long", "", [("A", [words(20), sents(12, 6), words(15)])], []),
        ("cut", "", [("A", [words(80)])], []),
    ]
    schema = "paper_id string, abstract string, sections array<struct<title:string,paragraphs:array<string>>>, equations array<struct<text_description:string,context_before:string,context_after:string>>"
    df = spark.createDataFrame(data, schema)
    got = {}
    for r in chunking.chunk_documents(df, settings_).orderBy("paper_id", "chunk_index").collect():
        got.setdefault(r["paper_id"], []).append(r)
    assert [(c["chunk_type"], c["token_count"]) for c in got["small"]] == [("abstract", 12), ("text", 40)]
    packed = got["packed"]
    assert [c["token_count"] for c in packed] == [30, 40, 40]
    assert packed[1]["content"].startswith("a20 a21") and packed[1]["has_overlap_before"] and packed[0]["has_overlap_after"]
    assert [c["form"] for c in got["long"]] == ["paragraphs", "sentences", "sentences", "paragraphs"]
    assert [(c["form"], c["token_count"]) for c in got["cut"]] == [("truncated", 50)]
    assert all([c["chunk_id"] for c in v] == [f"{k}_chunk_{i}" for i in range(len(v))] for k, v in got.items())


def test_equation_chunks(spark):
    data = [("p", "", [], [("a described equation with more than ten words in its text", "before", ""), ("short", None, None), (None, "x", "y")])]
    schema = "paper_id string, abstract string, sections array<struct<title:string,paragraphs:array<string>>>, equations array<struct<text_description:string,context_before:string,context_after:string>>"
    got = chunking.chunk_documents(spark.createDataFrame(data, schema)).collect()
    assert len(got) == 1 and got[0]["content"].startswith("Context: before\n\na described")


@pytest.mark.parametrize("sketch,bits", [(16, (1 << 12, 1 << 26)), (1, (64, 64))])
def test_containment_equals_every_pair(spark, monkeypatch, sketch, bits):
    """Passages of every length class, repeated ones, ones that span words; with a sketch and a filter too small to tell them apart, too."""
    monkeypatch.setattr(containment, "SKETCH_BITS", sketch)
    monkeypatch.setattr(containment, "FILTER_BITS", bits)
    rnd = random.Random(5)
    vocab = ["ab", "abc", "bc", "x", "yy", "zzz", "ünï", "😀"]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (None, "ab abc")]
    passages = []
    for i in range(40):
        text = docs[rnd.randrange(60)][1]
        a = rnd.randint(0, max(0, len(text) - 2))
        passages.append((100 + i, text[a : a + rnd.choice([1, 2, 3, 5, 9, 17, 33, 60])] or "q"))
    passages += [(200, "nowhere to be found"), (201, passages[0][1]), (202, ""), (203, None), (None, "ab"), (204, docs[3][1] + "!")]
    want = {(d, p) for d, t in docs for p, s in passages if t and s and d is not None and p is not None and s in t}
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    p = spark.createDataFrame(passages, "item_id int, passage string")
    columns = dict(doc_id="doc_id", doc_text="text", passage_id="item_id", passage_text="passage")
    got = containment.contains_join(d, p, **columns).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["item_id"]) for r in got} == want
    assert containment.contains_join(d, p.limit(0), **columns).isEmpty() and containment.contains_join(d.limit(0), p, **columns).isEmpty()


def test_anchor_is_the_rarest_window(spark):
    """A passage that begins like every text is looked up by its own words."""
    docs = spark.createDataFrame([(i, "a very common beginning of all texts here " + "tail" * (i % 3)) for i in range(50)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "of all texts here tailtail"), (2, "a very common beginning of all texts here XQ")], "item_id int, passage string")
    counts = containment.corpus_counts(docs.select("text"), asked)
    assert set(counts) == {16, 32} and max(counts[16].max(), counts[32].max()) >= 50
    got = containment.contains_join(docs, asked, doc_id="doc_id", doc_text="text", passage_id="item_id", passage_text="passage").collect()
    assert {r["doc_id"] for r in got} == {i for i in range(50) if i % 3 == 2} and {r["item_id"] for r in got} == {1}


def test_unicode_space_and_words(spark):
    assert one(spark, tx.word_count, "a\u00a0b\u2003c  d", "", " ") == [4, 0, 0]
    assert one(spark, tx.tokens, "Éa-b, C3!") == [["éa", "b", "c3"]]


def test_markdown_is_a_fallback_and_unasked_fields_are_not_computed(spark):
    """Same rows as by the join of two full parses; counting methods reads neither titles nor equations."""
    tex = "\\title{T {x}}\\begin{document}\\section{One}A paragraph that is long enough $$a$$ here.\\end{document}"
    md = "# Title\n\n## Abstract\nShort.\n\n## Part\n\nA paragraph that is long enough\n\n$$ e $$\n"
    rows = [(1, tex, md), (2, tex, None), (3, None, md), (4, "no heading", md), (5, "no heading", None), (6, None, "nothing"), (7, None, None), (8, "", "")]
    df = spark.createDataFrame(rows, "paper_id int, latex string, markdown string")
    latex = parsing.parse_latex(df.where("latex is not null").withColumnRenamed("latex", "content"))
    markdown = parsing.parse_markdown(df.where("markdown is not null"))
    want = {r["paper_id"]: tuple(r) for r in parsing.parse_with_fallback(latex, markdown).collect()}
    done = parsing.parse_sources(df)
    got = {r["paper_id"]: tuple(r) for r in done.collect()}
    assert {k: v for k, v in got.items() if k != 7} == want and got[7][-1] == "no sections found"
    assert done.columns == ["paper_id", "title", "abstract", "sections", "equations", "figures", "parse_method", "error"]
    text = done.groupBy("parse_method", F.col("error").isNull()).count()._jdf.queryExecution().optimizedPlan().toString()
    assert "icmltitle" not in text and "equation" not in text
