"""Near-duplicates, fingerprints, suffix dedup and decontamination against brute force."""

import random
from hashlib import sha256

import pytest

from paperloom.llm import components, decontaminate, fingerprint, near_dedup, suffix_dedup
from tests.llm.rows import PROSE, awkward, documents, empty


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def family(seed=1):
    """Groups of near copies with few and many edits, chains, exact copies and unrelated texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        base = [f"v{rng.randrange(400)}" for _ in range(90)]
        texts += [" ".join(edited(base, rng, rng.randrange(5))) for _ in range(12)]
        step = base
        for _ in range(8):
            step = edited(step, rng, 2)
            texts.append(" ".join(step))
        texts += [texts[-1], texts[-1].upper()]
    return texts + ["two words", "two words", "one", "", None]


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i + 1: (find(i) + 1, len(s)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    texts = family()
    out = near_dedup.near_duplicates(documents(spark, texts), width=width, percent=percent).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in out} == brute_components(texts, width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_dedup_edges(spark):
    out = near_dedup.near_duplicates(awkward(spark)).collect()
    assert len(out) == 9
    by = {r["doc_id"]: r for r in out}
    assert by[6]["component_id"] == 1 and by[None]["component_id"] is None and by[None]["kept"] and by[2]["kept"] and by[3]["n_shingles"] == 0
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_an_id_over_two_texts_has_two_decisions(spark):
    copy, lone = PROSE * 2, "quite another text that nothing else in the table holds, not even in part, one would hope"
    near = copy.replace("grey", "dark")
    for table in ([(1, copy), (2, copy), (2, lone)], [(2, lone), (2, copy), (1, copy)], [(5, copy), (5, near), (7, lone)]):
        out = near_dedup.near_duplicates(documents(spark, [t for _, t in table], doc_id=[i for i, _ in table]), percent=70).collect()
        assert len(out) == 3
        firsts = sorted(r["doc_id"] for r in out if r["first"])
        assert firsts == ([1, 2] if table[0][0] != 5 else [5, 7])


def test_planted_near_copies_are_found(spark):
    """Pairs around the threshold: every one at or above it is linked, none below."""
    import random

    pick = random.Random(11)
    texts, planted = [], []
    for k in range(120):
        words = [f"w{pick.randrange(10**6)}" for _ in range(200)]
        edited = list(words)
        for _ in range(1 + k % 9):
            edited[pick.randrange(200)] = f"e{pick.randrange(10**6)}"
        planted.append((len(texts) + 1, len(texts) + 2))
        texts += [" ".join(words), " ".join(edited)]
    want = brute_components(texts, 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    linked = [p for p in planted if want[p[1]][0] == p[0]]
    assert 40 < len(linked) < len(planted) and got == {i: c for i, (c, _) in want.items()}


def test_star_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(2, 60)] + [(5, 5), (None, 3), (7, None)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def lz_brute(text):
    seen, out, at = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[at:end] not in seen or end == len(text):
            seen.add(text[at:end])
            out.append(text[at:end])
            at = end
    return out


def test_phrases_equal_the_plain_parse():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abä") for _ in range(rng.randrange(120)))
        starts, ends = fingerprint.phrases(text)
        assert [text[a:b] for a, b in zip(starts, ends)] == lz_brute(text)


def test_next_documents(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeé \n") for _ in range(rng.randrange(200))) for _ in range(60)] + [None, ""]
    ids = rng.sample(range(-500, 500), len(texts))
    out = {r["doc_id"]: r for r in fingerprint.beside_next(documents(spark, texts, doc_id=ids)).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    assert len(out) == len(texts)
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        a, b, c = (fingerprint.signature(t) for t in (text, changed, after))
        r = out[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.encoded(a), fingerprint.encoded(b))
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))


def test_likeness_estimates_the_phrase_overlap():
    a, b = PROSE * 5, PROSE * 3 + PROSE[::-1] * 2
    x, y = set(lz_brute(a)), set(lz_brute(b))
    assert abs(fingerprint.likeness(fingerprint.signature(a), fingerprint.signature(b)) - len(x & y) / len(x | y)) < 0.15


def test_fingerprint_edges(spark):
    assert fingerprint.beside_next(awkward(spark)).count() == 9
    assert fingerprint.beside_next(documents(spark, ["alone"])).collect()[0]["near_next"] == 1.0
    assert fingerprint.beside_next(empty(spark)).count() == 0
    assert fingerprint.fingerprint(awkward(spark), out="score").where("doc_id = 3").collect()[0]["score"] == ""


def remove_brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raw):
        for p in range(len(b) - 199):
            seen.setdefault(b[p:p + 200], []).append((i, p))
    gone = [bytearray(len(b)) for b in raw]
    for where in seen.values():
        if len(where) > 1:
            for i, p in where:
                gone[i][p:p + 200] = b"\x01" * 200
    return [(len(b), sum(g), sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1])), sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()) for b, g in zip(raw, gone)]


def passages(seed=5):
    """Shared passages with edits near either end, boilerplate, periodic texts, NUL bytes, copies."""
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdefgh äö\n") for _ in range(n))

    shared = [noise(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = []
    for _ in range(60):
        parts = [noise(rng.randrange(150))]
        for _ in range(rng.randrange(4)):
            piece = list(rng.choice(shared))
            if rng.random() < 0.5:
                piece[rng.randrange(len(piece))] = "#"
            parts += ["".join(piece), noise(rng.choice([0, 0, 3, 80]))]
        texts.append("".join(parts))
    return texts + ["it " * 400, "it " * 90, "for " * 300, texts[0], None, "", "short", "\0" * 450, "a\0" * 300, PROSE * 3, "x" + PROSE * 2]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 4])
def test_removed_bytes_equal_brute_force(spark, hot):
    """With the limit at four most anchors take the way of very frequent ones."""
    texts = passages()
    want = remove_brute(texts)
    for r in suffix_dedup.remove_repeats(documents(spark, texts), hot=hot).collect():
        assert tuple(r)[1:] == want[r["doc_id"] - 1], r["doc_id"]


def test_loser_tree_keeps_shared_prefixes():
    rng = random.Random(6)
    for n_runs in (1, 2, 3, 7):
        runs = []
        for _ in range(n_runs):
            keys = sorted(bytes(rng.choice(b"ab") for _ in range(12)).ljust(suffix_dedup.LENGTH, b"x") for _ in range(rng.randrange(40)))
            runs.append((keys, [0] + [next((i for i in range(200) if a[i] != b[i]), 200) for a, b in zip(keys, keys[1:])] if keys else []))
        order, lengths = suffix_dedup.merged(runs)
        keys = [runs[r][0][i] for r, i in order]
        assert keys == sorted(k for run, _ in runs for k in run)
        assert lengths[1:] == [next((i for i in range(200) if a[i] != b[i]), 200) for a, b in zip(keys, keys[1:])]


def test_suffix_dedup_edges(spark):
    out = suffix_dedup.remove_repeats(awkward(spark), keep_text=True).collect()
    assert len(out) == 9 and all(r["n_removed"] == 0 for r in out)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_leaks(spark):
    item = "A train leaves Boston at 9:30 and travels 120 km in 2 hours, how fast does it go on average per hour"
    moved = item.replace("Boston", "Chicago").replace("9:30", "10:45").replace("120", "300")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, ""), (None, item)], "item_id long, text string")
    docs = documents(spark, [f"{PROSE}{item.upper().lower()} {PROSE}", f"{PROSE} {item}. {PROSE}", f"{PROSE} {moved}. {PROSE}", PROSE, None, "", f"{PROSE} {item[:40]} {PROSE}", "too short"])
    out = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert out[(2, 1)] is True and out[(3, 1)] is False and out[(8, 2)] is True
    assert not {d for d, _ in out} & {4, 5, 6, 7}


def test_slots_must_agree(spark):
    item = "Tom gives 5 apples to Ann and then Ann gives 5 apples back to Tom before the evening ends"
    start = "So then "
    bench = spark.createDataFrame([(1, start + item)], "item_id long, text string")
    same = item.replace("5", "7")
    torn = item.replace("5", "7", 1)
    out = {r["doc_id"] for r in decontaminate.find_leaks(documents(spark, [start + same, start + torn]), bench).collect()}
    assert out == {1}


def test_leaks_in_another_case_or_with_names_that_open_sentences(spark):
    item = "A train leaves Boston at 9:30 and travels 120 km in 2 hours, how fast does it go on average per hour"
    moved = item.replace("9:30", "10:45").replace("120", "300")
    shop = "Maria buys 12 apples for 3 dollars each. Maria gives 4 apples to Tom. Élodie takes 2 of them. How many apples does Maria keep"
    other = shop.replace("Maria", "Paula").replace("12", "15").replace("Élodie", "Zoé")
    torn = other.replace("does Paula", "does Maria").replace("gives 4", "gives 15")
    bench = spark.createDataFrame([(1, item), (2, shop)], "item_id long, text string")
    texts = [item.lower(), item.upper(), moved.lower(), shop.lower(), shop.upper(), other, other.replace(". ", "\n"), shop.replace("12", "15").replace("gives 4", "gives 15"), torn]
    out = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.find_leaks(documents(spark, [f"{PROSE}{t}. {PROSE}" for t in texts]), bench).collect()}
    assert {k: out.get(k) for k in [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 2)]} == {
        (1, 1): True, (2, 1): True, (3, 1): False, (4, 2): True, (5, 2): True, (6, 2): False, (7, 2): False}
    assert not {d for d, _ in out} & {9} and len({d for d, i in out if (d, i) not in {(n, 1 if n < 4 else 2) for n in range(1, 10)}}) == 0


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "plain words in a row here")], "item_id long, text string")
    out = decontaminate.find_leaks(awkward(spark), bench).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 6]
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(awkward(spark), bench.limit(0)).count() == 0
