"""Passages by chaining and benchmark templates against brute force, planted cases, and odd inputs."""

import itertools
import random
import re

import numpy as np

from cytomosaic.llm import chaining, queries, templates
from tests.llm.conftest import edited, odd_rows, words

# --- chains ----------------------------------------------------------------------------------------------------------


def test_chains_are_best():
    """The first chain's score is that of the best of all chains."""
    source = random.Random(4)
    for _ in range(60):
        n = source.randint(1, 8)
        points = sorted({(source.randrange(60), source.randrange(60)) for _ in range(n)})
        a, b = np.array([p[0] for p in points]), np.array([p[1] for p in points])

        def worth(chain):
            total = chaining.SEED_WORTH
            for i, j in itertools.pairwise(chain):
                total += chaining.SEED_WORTH - chaining.GAP_COST * (a[j] - a[i] + b[j] - b[i])
            return total

        rising = [c for r in range(1, len(points) + 1) for c in itertools.combinations(range(len(points)), r) if all(a[i] < a[j] and b[i] < b[j] for i, j in itertools.pairwise(c))]
        got = chaining.chains(a, b, 1)
        assert abs(worth(got[0]) - max(map(worth, rising))) < 1e-9
        assert sorted(i for c in got for i in c) == list(range(len(points)))


def test_chains_within_the_gap():
    """A second passage behind a longer gap is a chain of its own, and scores are those of all chains without longer gaps."""
    first = [(10 * i, 10 * i) for i in range(28)]
    second = [(270 + 150 + 10 * i, 270 + 120 + 10 * i) for i in range(9)]
    points = np.array(first + second)
    assert [len(c) for c in chaining.chains(points[:, 0], points[:, 1], 2)] == [28, 9]
    source = random.Random(14)
    for _ in range(60):
        points = sorted({(source.randrange(400), source.randrange(400)) for _ in range(source.randint(2, 40))})
        points += [(500 + 5 * i, 450 + 5 * i + source.randrange(3)) for i in range(source.randint(0, 30))]
        score = {}
        for x, y in points:
            near = [s - chaining.GAP_COST * (x - u + y - v) for (u, v), s in score.items() if 0 < x - u <= chaining.LONGEST_GAP and 0 < y - v <= chaining.LONGEST_GAP]
            score[x, y] = chaining.SEED_WORTH + max([0, *near])
        at = np.array(points)
        got = chaining.chains(at[:, 0], at[:, 1], 1)[0]
        own = chaining.SEED_WORTH * len(got) - chaining.GAP_COST * sum((at[got[-1]] - at[got[0]]).tolist())
        assert abs(own - max(score.values())) < 1e-9


def test_passages_with_a_longer_gap(make):
    one, two = words(61, 280), words(62, 90)
    rows = [(1, f"{one} {words(63, 150)} {two} {words(64, 20)}"), (2, f"{one} {words(65, 120)} {two} {words(66, 35)}")]
    got = {r["doc_id"]: r for r in chaining.repeated_passages(make(rows)).collect()}
    assert [len(got[i]["spans"]) for i in (1, 2)] == [2, 2]
    assert got[1]["spans"][1]["start"] <= 430 and got[1]["spans"][1]["end"] >= 520


def test_seeds_of_edited_passages(make):
    """Two texts with a passage at the limits, 50 words and 80 %, nearly always have the seeds of a chain in common."""
    source = np.random.default_rng(5)

    def text(middle):
        return np.concatenate([source.integers(1, 1 << 63, 40, np.uint64), middle, source.integers(1, 1 << 63, 40, np.uint64)])

    lost = 0
    for _ in range(400):
        one = source.integers(1, 1 << 63, 50, np.uint64)
        two = np.where(np.isin(np.arange(50), source.permutation(50)[:10]), source.integers(1, 1 << 63, 50, np.uint64), one)
        seeds = [chaining.seeds_of(text(x), chaining.SEED, chaining.WINDOW)[1] for x in (one, two)]
        places = np.flatnonzero(np.isin(chaining.windows(one, chaining.SEED), np.intersect1d(*seeds)))
        lost += len(places) < chaining.LEAST_SEEDS or places[-1] - places[0] < chaining.SEED
    assert lost <= 4
    rows = []
    for i in range(40):
        own = words(1000 + i, 50, 10**6).split()
        places = range(6, 48, 6)
        changed = [f"z{p}y{i}" if p in places else w for p, w in enumerate(own)]
        rows += [(2 * i + j, " ".join([words(2000 + 2 * i + j, 60, 10**6), *x, words(3000 + 2 * i + j, 30, 10**6)])) for j, x in enumerate((own, changed))]
    assert chaining.repeated_passages(make(rows)).count() >= 78


def test_fenwick_maxima():
    source = random.Random(9)
    tree, seen = chaining.LargestBefore(50), []
    for i in range(300):
        place, score = source.randrange(50), source.random()
        tree.put(place, score, i)
        seen.append((place, score, i))
        limit = source.randrange(51)
        best = max(((s, o) for p, s, o in seen if p < limit), default=None)
        assert (tree.below(limit) == best) if best else tree.below(limit)[1] == -1


def test_gap_alignment_is_longest():
    source = random.Random(2)
    for _ in range(100):
        a, b = (np.array([source.randrange(4) for _ in range(source.randint(0, 7))]) for _ in range(2))
        best = 0
        for r in range(len(a) + 1):
            for keep in itertools.combinations(a.tolist(), r):
                rest = iter(b.tolist())
                if all(x in rest for x in keep):
                    best = r
        got = chaining.gap_alignment(a, b)
        assert len(got) == best and all(a[i] == b[j] for i, j in got)


def test_planted_passages(make):
    exact, fuzzy, short = words(51, 70), words(52, 120), words(53, 30)
    rows = [(i, f"{words(100 + i, 60)} {exact} {words(200 + i, 40)}") for i in range(12)]
    rows += [(20 + i, f"{words(300 + i, 50)} {edited(fuzzy, i, 0.06)} {words(400 + i, 20)}") for i in range(8)]
    rows += [(40 + i, f"{words(500 + i, 50)} {short} {words(600 + i, 50)}") for i in range(6)]
    rows += [(60 + i, words(700 + i, 200)) for i in range(10)]
    got = {r["doc_id"]: r for r in chaining.repeated_passages(make(rows)).collect()}
    assert set(got) == {*range(12), *range(20, 28)}
    for i in range(12):
        (span,) = got[i]["spans"]
        assert span["start"] <= 60 and span["end"] >= 130 and span["end"] - span["start"] <= 76
    for i in range(20, 28):
        assert sum(min(s["end"], 170) - max(s["start"], 50) for s in got[i]["spans"]) > 90


def test_exact_windows_of_the_query(spark, small):
    docs = {r["doc_id"]: r["text"].encode().lower().split() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    owners = {}
    for i, own in docs.items():
        for p in range(len(own) - 50):
            owners.setdefault(tuple(own[p : p + 51]), set()).add(i)
    want = set().union(*[o for o in owners.values() if len(o) > 1])
    got = {r["doc_id"]: r for r in queries.op2_collinear_passages(spark, small).collect()}
    assert want <= set(got)
    for i in want:  # every repeated window lies in a span
        spans = [tuple(map(int, s.split(":"))) for s in got[i]["spans"].split(",")]
        for p in range(len(docs[i]) - 50):
            if len(owners[tuple(docs[i][p : p + 51])]) > 1:
                assert any(s <= p and p + 51 <= e for s, e in spans)


def test_passages_odd_rows(make):
    got = {r["doc_id"]: r for r in chaining.repeated_passages(make(odd_rows())).collect()}
    assert set(got) == {6, 7, 8, 9, 10}
    assert [(s["start"], s["end"]) for s in got[6]["spans"]] == [(0, 30_000)]
    assert (got[8]["partner"], got[9]["partner"]) == (9, 8)
    assert chaining.repeated_passages(make([])).count() == 0


def test_passages_between_their_holders(make):
    """The least and the largest holders of a passage's seeds have parts of it that are too short; all between have all of it."""
    for seed, length, part in ((81, 60, 45), (82, 70, 48), (83, 50, 49)):
        own = words(seed, length).split()
        parts = {1: own[:part], 100: own[:part], 2: own[-part:], 101: own[-part:]}
        rows = [(i, " ".join([*words(800 + i, 40).split(), *parts.get(i, own), *words(950 + i, 30).split()])) for i in (*parts, *range(10, 91))]
        got = {r["doc_id"]: r for r in chaining.repeated_passages(make(rows)).collect()}
        for i in range(10, 91):
            assert any(s["start"] <= 40 and s["end"] >= 40 + length for s in got[i]["spans"]), (length, i)
            assert got[i]["partner"] is not None


# --- templates -------------------------------------------------------------------------------------------------------

ITEM = "A train leaves Paris at 9 and travels 120 km to Lyon. When Anna counts 120 km from Paris, how many hours did the train take on its way?"
OTHER = "the tall farmer sells apples and pears in the market while his daughter feeds the brown horse near the old stone bridge"


def items(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "item_id long, text string, cover string")


def test_templates(spark, make):
    changed = ITEM.replace("Paris", "New York").replace("120", "75").replace("Lyon", "Boston").replace("Anna", "Omar")
    clash = ITEM.replace("120", "75", 1)  # one 120 became 75, the other stayed
    rows = [
        (1, f"{words(1, 30)}. {ITEM} {words(2, 30)}"),
        (2, f"{words(3, 30)}. {changed} {words(4, 30)}"),
        (3, f"{words(5, 30)}. {clash} {words(6, 30)}"),
        (4, f"{words(7, 300)} {OTHER.upper()} {words(8, 10)}"),
        (5, words(9, 400)),
        (6, OTHER[: len(OTHER) // 2]),
        *[(i + 100, t) for i, t in odd_rows() if i is not None],
        (None, ITEM),
    ]
    bench = items(spark, [(1, ITEM), (1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too 1 2 3"), (None, OTHER)])
    got = {(r["doc_id"], r["item"]): r for r in templates.contaminated(make(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2), (None, 1)}
    assert got[1, 1]["n_changed"] == 0 and got[2, 1]["n_changed"] >= 3
    assert templates.contaminated(make([]), bench).count() == 0
    assert templates.contaminated(make(rows), items(spark, [])).count() == 0


def test_items_with_repeated_templates(spark, make):
    """An item that repeats its own template, beside variants of itself, and one that is nearly all numbers."""
    twice = "Tom has 3 apples and 2 pears. Ann has 5 apples and 4 pears. How many apples do they have?"
    sheet = "Ben buys 7 pens for 3 euros at the shop."
    sums = "Add 12 15 18 21 24 27 30 33 and 36 together."
    variants = " ".join(sheet.replace("7", str(n)).replace("3 e", f"{n + 1} e") for n in range(20, 26))
    rows = [
        (1, f"{words(1, 30)}. {twice} {words(2, 30)}"),
        (2, f"{words(3, 30)}. {twice.replace('3', '8').replace('Tom', 'Eve')} {words(4, 30)}"),
        (3, f"{words(5, 30)}. {variants} {sheet} {variants} {words(6, 30)}"),
        (4, f"{words(7, 30)}. {sums} {words(8, 30)}"),
        (5, f"{words(9, 30)}. {sums.replace('15', '16')} {words(8, 30)}"),
        (6, f"{words(7, 30)}. {twice.replace('and 2 pears', 'and, well, 2 pears')} {words(8, 30)}"),
    ]
    got = {(r["doc_id"], r["item"]): r["n_changed"] for r in templates.contaminated(make(rows), items(spark, [(1, twice), (2, sheet), (3, sums)])).collect()}
    assert got[1, 1] == got[3, 2] == got[4, 3] == got[6, 1] == 0
    assert got[2, 1] > 0 and (5, 3) not in got


def test_verbatim_items_are_found(spark, make):
    """Random items out of few words, numbers and names, so that their windows repeat, stand word for word in documents."""
    source = random.Random(5)
    bench = [" ".join(source.choice(["has", "apples", "and", "Ann", "Tom", "3", "5", "km", "pears", "12", ".", "buys"]) for _ in range(source.randint(8, 40))) for _ in range(60)]
    rows = [(i, f"{words(i, 20)}. {bench[i]} . {bench[(i + 1) % 60]}. {words(i + 99, 20)}") for i in range(60)]
    got = {(r["doc_id"], r["item"]) for r in templates.contaminated(make(rows), items(spark, list(enumerate(bench)))).collect()}
    assert {(i, i) for i in range(60)} | {(i, (i + 1) % 60) for i in range(60)} <= got


TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?:;\"\n%$€£]")


def plain_kind(token):
    if token[0].isdigit():
        return templates.NUMBER
    if not token[0].isalpha():
        return templates.UNIT if token in "%$€£" else templates.MARK
    if token.lower() in templates.UNITS:
        return templates.UNIT
    return templates.CAPITAL if token[0].isupper() and len(token) > 1 and not token.isupper() else templates.LITERAL


def test_tokens(monkeypatch):
    """Tokens are those of a regular expression, and hash alike exactly if they are alike but for their case."""
    monkeypatch.setattr(templates, "SPLIT_AT_ONCE", 40)
    source, known = random.Random(6), {}
    letters = ["a", "b", "Ab", "AB", " ", " ", "\n", "1", ",", ".", "5", "'", "’", "é", "É", "\xa0", "\x85", "\u2028", "%", "$", "ß", "km", "_", "\U0001d400", "😀", "日", "٣", "!"]
    for n in range(400):
        text = "".join(source.choice(letters) for _ in range(n))
        found = TOKEN.findall(text)
        _, hashes, kinds = (np.concatenate(c) for c in zip(*map(templates.split, templates.parts_of(text))))
        assert [plain_kind(t) for t in found] == kinds.tolist()
        for token, h in zip(found, hashes.tolist()):
            assert known.setdefault(token.lower(), h) == h
    assert len(set(known.values())) == len(known) > 500
    assert all(templates.split(u)[2].tolist() == [templates.UNIT] for u in templates.UNITS)


def test_texts_together():
    """Texts of one batch do not change one another."""
    source = random.Random(8)
    texts = [" ".join(source.choice(["Ann", "has", "3", "km", ".", "%", "Bob", "and"]) for _ in range(source.randrange(9))) for _ in range(200)] + ["", "\n"]
    *columns, bounds = templates.canonical(texts)
    for i, text in enumerate(texts):
        alone = templates.canonical([text])
        assert [c[bounds[i] : bounds[i + 1]].tolist() for c in columns] == [c.tolist() for c in alone[:3]]


def test_blocks_of_windows(spark, make, monkeypatch):
    """A benchmark searched in many blocks gives the same."""
    monkeypatch.setattr(templates, "SENT_WINDOWS", 7)
    rows = [(1, OTHER), (2, words(3, 50)), (3, f"{words(4, 20)} {OTHER}")]
    got = templates.contaminated(make(rows), items(spark, [(9, OTHER)])).collect()
    assert {(r["doc_id"], r["cover"]) for r in got} == {(1, 100), (3, 100)}


def test_leak_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    bench = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_template_leaks(spark, small).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want)


def test_words_of_whole_batches():
    rng = np.random.default_rng(11)
    texts = [b"", b" \t\n", b"one", "A b\x0bÄ x B a".encode(), b"long " + b"x" * 200 + b" LONG " + b"X" * 200, b"w" * 70]
    texts += [" ".join(rng.choice(["ab", "ba", "aab", "AB", "é"], 40)).encode() for _ in range(20)]
    words = chaining.Words()
    found, bounds = words.of_all(texts)
    plain = [x.lower().split() for x in texts]
    assert np.diff(bounds).tolist() == [len(x) for x in plain]
    flat = [w for x in plain for w in x]
    assert len(set(found.tolist())) == len(set(flat)) == len(set(zip(found.tolist(), flat, strict=True)))
    for x, raw in enumerate(texts):
        assert (words.of(raw) == found[bounds[x] : bounds[x + 1]]).all()


def test_seeds_of_whole_batches():
    rng = np.random.default_rng(12)
    sizes = [0, 1, 3, 4, 7, 8, 9, 0, 50, 200, 5]
    bounds = np.cumsum([0, *sizes])
    numbers = chaining.mixed(rng.integers(0, 6, bounds[-1]).astype(np.uint64))
    ends, places, found = chaining.batch_seeds(numbers, bounds, 4, 5)
    for x in range(len(sizes)):
        at, grams = chaining.seeds_of(numbers[bounds[x] : bounds[x + 1]], 4, 5)
        assert places[ends[x] : ends[x + 1]].tolist() == at.tolist()
        assert found[ends[x] : ends[x + 1]].tolist() == grams.tolist()


def test_stretches_match_by_match():
    def plain(at, least_words, percent):
        worth, out, total, best, first, last = 100 - percent, [], 0, 0, 0, 0
        for x in range(len(at)):
            if x:
                total -= percent * (max(at[x][0] - at[x - 1][0], at[x][1] - at[x - 1][1]) - 1)
            if total <= 0 or best - total > worth * least_words:
                out += [(first, last)] if best > 0 else []
                total = best = 0
                first = x
            total += worth
            if total >= best:
                best, last = total, x
        out += [(first, last)] if best > 0 else []
        ends = [(*at[x], at[y][0] + 1, at[y][1] + 1, y - x + 1) for x, y in out]
        return [(a, c, b, d, n) for a, b, c, d, n in ends if min(c - a, d - b) >= least_words]

    rng = np.random.default_rng(13)
    for _ in range(200):
        steps = np.where(rng.random((120, 2)) < 0.85, 1, rng.integers(1, 12, (120, 2)))
        at = np.cumsum(steps, 0)
        assert chaining.stretches(at, 10, 80) == plain(at.tolist(), 10, 80)


def test_families_of_edited_passages(make):
    """Members of large families find every partner that comparing all members word by word finds."""
    rnd = np.random.default_rng(14)
    rows, kept = [], []
    for family, (members, words, rate) in enumerate([(12, 60, 0.1), (60, 60, 0.1), (60, 120, 0.1), (60, 60, 0.05), (150, 80, 0.1)]):
        for _ in range(members):
            same = rnd.random(words) >= rate
            passage = [f"f{family}w{i}" if x else f"e{rnd.integers(1 << 40)}" for i, x in enumerate(same)]
            around = [[f"r{rnd.integers(1 << 40)}" for _ in range(rnd.integers(20, 90))] for _ in range(2)]
            kept.append((family, same))
            rows.append(" ".join([*around[0], *passage, *around[1]]))
    ids = rnd.permutation(len(rows)).tolist()
    linked: dict[int, set[int]] = {}
    for x, (family, same) in enumerate(kept):
        for y in range(x):
            both = np.flatnonzero(same & kept[y][1]) if kept[y][0] == family else []
            if any(j - i >= 49 and 100 * (m - n + 1) >= 80 * (j - i + 1) for n, i in enumerate(both) for m, j in enumerate(both)):
                linked.setdefault(ids[x], set()).add(ids[y])
                linked.setdefault(ids[y], set()).add(ids[x])
    got = {r["doc_id"]: r for r in chaining.repeated_passages(make(list(zip(ids, rows, strict=True)))).collect()}
    assert set(got) == set(linked)
    for doc, partners in linked.items():
        assert (got[doc]["partner"], got[doc]["n_partners"]) == (min(partners), len(partners))


def test_places_in_very_many_documents_are_met(make, monkeypatch):
    """Two texts share 50 words, 80 % of them, only through phrases of four words that many documents have; slices lose none."""
    monkeypatch.setattr(chaining, "SLICE", 7)
    phrases = [words(5000 + i, 4, 10**6) for i in range(10)]
    rows = [(i, " ".join(f"{p} r{i}x{j}" for j, p in enumerate(phrases[i % 3 :]))) for i in range(40)]
    got = {r["doc_id"]: r for r in chaining.repeated_passages(make(rows)).collect()}
    assert got == {}  # 49 words and fewer
    rows = [(i, " ".join([*(f"{p} r{i}x{j}" for j, p in enumerate(phrases[i % 3 :])), "last"])) for i in range(40)]
    got = {r["doc_id"]: r for r in chaining.repeated_passages(make(rows)).collect()}
    whole = set(range(0, 40, 3))
    assert set(got) == whole and all(r["n_partners"] == len(whole) - 1 for r in got.values())


def test_lone_runs_are_compared_word_by_word(make):
    """One run of ten words, and runs of three: no other seed, and 40 of 50 words agree."""
    own = words(7100, 50, 10**6).split()
    edits = range(10, 50, 4)
    other = [f"z{p}" if p in edits else w for p, w in enumerate(own)]
    rows = [(1, " ".join([*own, "e1"])), (2, " ".join([*other[:49], own[49], "e2"]))]
    got = {r["doc_id"]: r["n_partners"] for r in chaining.repeated_passages(make(rows)).collect()}
    assert got == {1: 1, 2: 1}
