"""Operators on pairs and on repeated passages against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidelog.llm import line_dedup, linking, near_duplicates, suffix_dedup
from tidelog.llm.cluster import text_of

SCHEMA = "doc_id long, text string, row string, node string"
ODD = [(900, None), (901, ""), (902, " \n "), (None, "a text without an id, and long enough"), (904, "twice the same line of words"), (904, "twice the same line of words"), (904, "other words under one id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "n") for i, t in rows], SCHEMA)


def grouped(items, links):
    up = {i: i for i in items}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    return {i: top(i) for i in items}


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    tops = grouped({x for e in edges for x in e}, edges)
    least = {}
    for x, t in tops.items():
        least[t] = min(least.get(t, x), x)
    assert got == {x: least[t] for x, t in tops.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("turns", [0, 2, 12])
def test_groups_of_lists_lose_no_link(spark, turns):
    """Links are pairs at most 2 apart: large lists of several groups, and pairs that only the second step can find."""
    random.seed(2)
    lists = {k: random.sample(range(400), random.choice([2, 3, 9, 60])) for k in range(60)}
    posts = spark.createDataFrame([(k, n, n % 7) for k, own in lists.items() for n in own], "key long, node long, weight int")
    nodes = posts.select("node").distinct().withColumn("at", F.col("node"))
    near = lambda x, y: F.abs(F.col(f"{x}_at") - F.col(f"{y}_at")) <= 9
    got = {r["node"]: r["label"] for r in linking.groups(linking.lists_of(posts), nodes, near, lambda pairs: pairs.where("abs(a - b) <= 2"), turns).collect()}
    links = [(a, b) for own in lists.values() for a in own for b in own if a < b <= a + 2]
    tops = grouped({n for own in lists.values() for n in own}, links)
    for a in tops:
        for b in tops:
            assert (got.get(a, a) == got.get(b, b)) == (tops[a] == tops[b])


@pytest.mark.parametrize("short", [5, 100])
def test_short_lists_lose_no_link_and_take_no_turns(spark, monkeypatch, short):
    """Before, each node of a list of two or three was tried in each turn, and such lists are most."""
    random.seed(4)
    lists = {k: random.sample(range(300), random.choice([2, 3, 5, 30])) for k in range(80)}
    posts = spark.createDataFrame([(k, n, n % 7) for k, own in lists.items() for n in own], "key long, node long, weight int")
    nodes, seen = posts.select("node").distinct().withColumn("at", F.col("node")), []
    near = lambda x, y: F.abs(F.col(f"{x}_at") - F.col(f"{y}_at")) <= 9
    real = linking._Linker.attempts
    monkeypatch.setattr(linking._Linker, "attempts", lambda work, named, *more: seen.extend(r["key"] for r in named.collect()) or real(work, named, *more))
    exact = (nodes, lambda x, y: F.abs(F.col(f"{x}_at") - F.col(f"{y}_at")) <= 2)
    got = {r["node"]: r["label"] for r in linking.groups(linking.lists_of(posts), nodes, near, lambda pairs: pairs.where("abs(a - b) <= 2"), exact=exact, short=short).collect()}
    assert all(len(lists[k]) > short for k in seen) and bool(seen) == (short < 30)
    tops = grouped({n for own in lists.values() for n in own}, [(a, b) for own in lists.values() for a in own for b in own if a < b <= a + 2])
    assert all((got.get(a, a) == got.get(b, b)) == (tops[a] == tops[b]) for a in tops for b in tops)


def test_lists_of_dozens_of_lines_take_no_turns(spark, monkeypatch):
    """Before, lists of more than 8 lines did, and a turn shuffles several rows for each line of each list."""
    random.seed(31)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    lines = [" ".join(["shared words stand", *(word() for _ in range(12 + i))]) for i in range(40)]
    copies = [" ".join(line.split()[:-1] + [word()]) for line in lines[:10]]
    seen, real = [], linking._Linker.attempts
    monkeypatch.setattr(linking._Linker, "attempts", lambda work, named, *more: seen.extend(named.collect()) or real(work, named, *more))
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(frame(spark, list(enumerate(lines + copies))), radius=None).collect()}
    assert {i for i, n in out.items() if n} == set(range(40, 50)) and not seen


def test_last_step_takes_some_lists_at_a_time(spark, monkeypatch):
    """Before, all postings met the wide features at once, and pairs of one list were tested before the last step and in it."""
    random.seed(5)
    lists = {k: random.sample(range(100), random.choice([2, 9, 30])) for k in range(60)}
    posts = spark.createDataFrame([(k, n, n % 7) for k, own in lists.items() for n in own], "key long, node long, weight int")
    nodes, seen, tried = posts.select("node").distinct().withColumn("at", F.col("node")), [], []
    settle, confirm = linking._Linker.settled, linking._Linker.confirmed
    monkeypatch.setattr(linking._Linker, "settled", lambda work, named, *more: seen.append([(r["key"], r["node"]) for r in named.collect()]) or settle(work, named, *more))
    monkeypatch.setattr(linking._Linker, "confirmed", lambda work, pairs: tried.append([(r["x"], r["y"]) for r in pairs.collect()]) or confirm(work, pairs))
    exact = (nodes, lambda x, y: F.abs(F.col(f"{x}_at") - F.col(f"{y}_at")) <= 2)
    got = {r["node"]: r["label"] for r in linking.groups(linking.lists_of(posts), nodes, lambda x, y: F.lit(True), lambda pairs: pairs.where("abs(a - b) <= 2"), exact=exact).collect()}
    assert len(seen) > 2 and 2 * max(map(len, seen)) <= sum(map(len, seen))
    assert len({k for rows in seen for k, _ in rows}) == sum(len({k for k, _ in rows}) for rows in seen)  # a list is in one part
    assert tried[0] and all(sum(x in own and y in own for own in lists.values()) > 1 for pairs in tried[:-1] for x, y in pairs)
    tops = grouped({n for own in lists.values() for n in own}, [(a, b) for own in lists.values() for a in own for b in own if a < b <= a + 2])
    assert all((got.get(a, a) == got.get(b, b)) == (tops[a] == tops[b]) for a in tops for b in tops)


def test_last_step_shuffles_lines_once(spark, tmp_path):
    """Before, the two sides of its join were two tables, and each was shuffled."""
    tables = {"named": [(1, 10, 10), (1, 11, 11)], "forms": [(10, 5, "abcde"), (11, 5, "abcdf")]}
    for (name, rows), kind in zip(tables.items(), ("key long, node long, label long", "node long, size int, form string"), strict=True):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name))
    named, forms = (spark.read.parquet(str(tmp_path / name)) for name in tables)
    work = linking._Linker(forms.drop("form"), lambda x, y: line_dedup.near_sizes(F.col(f"{x}_size"), F.col(f"{y}_size"), 80), None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = work.rest(named, (forms, lambda x, y: line_dedup.similar(80, f"{x}_form", f"{y}_form", f"{x}_size", f"{y}_size")))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in pairs.collect()] == [(10, 11, 10, 11)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(made) == 2 and sum("ReusedExchange" in line for line in made) == 1


def test_runs_in_unlike_surroundings_make_no_candidates(spark, monkeypatch):
    """Before, the last step took the distance of each two lines that share a run; links stay, also of lines whose runs all stand many times."""
    random.seed(41)
    words = lambda n: ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)]
    lines = [[*words(20), *"the same few words stand".split(), *words(20)] for _ in range(30)]
    copies = [[w if i % 6 else words(1)[0] for i, w in enumerate(line)] for line in lines[:5]]
    chant = words(4) * 15
    rows = [" ".join(line) for line in [*lines, chant, *copies, [*chant[:30], *words(5), *chant[35:]]]]
    settled, tried, real = [], [], linking._Linker.confirmed
    monkeypatch.setattr(linking._Linker, "settled", lambda *_: settled.append(1))
    monkeypatch.setattr(linking._Linker, "confirmed", lambda work, pairs: tried.append(pairs.count()) or real(work, pairs))
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(frame(spark, list(enumerate(rows))), radius=None).collect()}
    assert {i for i, n in out.items() if n} == set(range(31, 37)) and not settled and tried[-1] < 30


# near-duplicates


def shingle_set(text, k):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else {tuple(own)} if own else set()


@pytest.mark.parametrize(("k", "bits"), [(4, 64), (5, 64), (4, 3)])  # with 3 bits most sets share their number with others
def test_near_duplicates(spark, k, bits):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(500)] + ["Été", "A.B"]
    common = [random.choice(vocabulary) for _ in range(50)]
    rows = []
    for i in range(60):
        base = [random.choice(vocabulary) for _ in range(random.choice([1, 3, 5, 40, 150]))] + (common if i % 3 == 0 else [])
        for _ in range(random.choice([1, 1, 2, 12 if i % 5 else 40])):
            own = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 6])):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((len(rows), random.choice([" ", "\n"]).join(own).upper() if random.random() < 0.2 else " ".join(own)))
    rows += ODD
    sets = [shingle_set(t, k) for _, t in rows]
    links = [(x, y) for x in range(len(rows)) for y in range(x) if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    tops = grouped(range(len(rows)), links)
    least = {}
    for x, t in tops.items():
        if rows[x][0] is not None:
            least[t] = min(least.get(t, rows[x][0]), rows[x][0])
    want = collections.Counter((rows[x][0], len(sets[x]), least.get(tops[x]) if sets[x] else rows[x][0]) for x in range(len(rows)))
    got = near_duplicates.near_duplicates(frame(spark, rows), shingle=k, bits=bits).collect()
    assert collections.Counter(tuple(r)[:3] for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    kept = near_duplicates.deduplicated(frame(spark, rows), shingle=k)
    assert kept.columns == ["doc_id", "text", "row", "node"]
    assert near_duplicates.near_duplicates(frame(spark, []).limit(0)).count() == 0


# lines


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def similar_pairs(spark, pairs):
    sizes = {f"{c}_size": F.length(c) for c in "xy"}
    return {(r["x"], r["y"]): r["s"] for r in spark.createDataFrame(pairs, "x string, y string").withColumns(sizes).select("x", "y", line_dedup.similar(80).alias("s")).collect()}


def some_pairs(most):
    random.seed(8)
    pairs = []
    for _ in range(400):
        own = ["".join(random.choice("abé") for _ in range(random.randint(1, 4))) for _ in range(random.randint(1, most))]
        other = list(own)
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(other) + 1)
            other[at : at + random.randint(0, 2)] = ["".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(random.randint(0, 2))]
        pairs.append((" ".join(own), " ".join(other or ["x"])))
    return pairs


def test_edit_similarity(spark):
    """Nothing but the edit distance counts, of however many words and characters."""
    found = similar_pairs(spark, some_pairs(12) + some_pairs(30))
    for (x, y), got in found.items():
        assert got == (5 * distance(x, y) <= max(len(x), len(y))), (x, y)
    assert 20 < sum(found.values()) < len(found)


@pytest.mark.parametrize("n", [6, 14, 40, 100])
def test_one_character_of_every_word_may_differ(spark, n):
    random.seed(n)
    own = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    far = [w[:2] + "xy" + w[4:] for w in own]
    near = [w[:2] + "x" + w[3:] for w in own]
    assert [similar_pairs(spark, [(" ".join(own), " ".join(other))]).popitem()[1] for other in (near, far)] == [True, False]


def test_edit_similarity_of_very_long_lines(spark):
    """A word more at one end and one less at the other, of 2,500 words."""
    random.seed(7)
    base = ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(2500)]
    moved, other = base[1:] + ["y"], ["".join(random.choice("ijkl") for _ in w) for w in base]
    own = " ".join(base)
    assert {y: got for (_, y), got in similar_pairs(spark, [(own, " ".join(y)) for y in (moved, other)]).items()} == {" ".join(moved): True, " ".join(other): False}


def test_line_dedup(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(random.choice(vocabulary) for _ in range(random.randint(1, 60))) for _ in range(40)]

    def edited(text):
        own = text.split()
        for _ in range(random.choice([0, 0, 1, 1, 2])):
            own[random.randrange(len(own))] = random.choice(vocabulary)
        return " ".join(own).upper() if random.random() < 0.2 else "  " * random.randint(0, 1) + " ".join(own)

    rows = [(i if i % 17 else None, "\n".join(edited(random.choice(base)) for _ in range(random.randint(0, 6)))) for i in range(120)]
    rows += [*ODD, (3, rows[3][1]), (3, "other text here now, under the same id")]
    docs = frame(spark, rows)
    keyed = docs.select(F.xxhash64(F.col("doc_id"), text_of()).alias("row"), "doc_id", text_of().alias("text"))
    prints = {(r["row"], r["line"]): (r["node"], r["print"]) for r in line_dedup.printed(line_dedup.lines_of(keyed)).collect()}
    places, form, print_of = {}, {}, {}
    for r in keyed.distinct().collect():
        for n, line in enumerate(r["text"].split("\n")):
            own = line.strip(" ").lower()
            assert (len(own) > 0) == ((r["row"], n) in prints)
            if own:
                node, bits = prints[r["row"], n]
                places[r["doc_id"] is None, r["doc_id"] or 0, r["row"], n] = node
                form[node], print_of[node] = own, bits
    nodes = sorted(form)
    links = [(a, b) for a in nodes for b in nodes if a < b and ((print_of[a] ^ print_of[b]) & (2**64 - 1)).bit_count() <= 3 and 5 * distance(form[a], form[b]) <= max(len(form[a]), len(form[b]))]
    assert len(links) > 20
    tops, first, gone = grouped(nodes, links), {}, collections.defaultdict(set)
    for place, node in sorted(places.items()):
        if first.setdefault(tops[node], place) != place:
            gone[place[2]].add(place[3])
    assert {r["row"]: set(r["removed"]) for r in line_dedup.removed_lines(keyed).collect()} == gone
    ids = {(r["doc_id"], r["text"]): r["row"] for r in keyed.collect()}
    want = collections.Counter()
    for i, t in rows:
        lines, lost = (t or "").split("\n"), gone.get(ids[i, t or ""], set())
        want[i, "\n".join(x for n, x in enumerate(lines) if n not in lost) if lost else t, len(lines), len(lost)] += 1
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "row", "node", "n_lines", "n_removed"]
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()) == want
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    stage = line_dedup.without_repeated_lines(docs.withColumn("n_chars", F.lit(1).cast("long")))
    assert stage.columns == ["doc_id", "text", "row", "node", "n_chars"] and stage.where("n_chars <> length(text)").count() == 0


def test_similar_lines_against_edit_similarity_alone(spark):
    """Lines with words replaced or misspelt: no group may go beyond edit similarity, and few links may be missed."""
    random.seed(12)
    vocabulary = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.choice([2, 3, 5, 6, 8, 9]))) for _ in range(2000)]
    lines = []
    for k in range(120):
        base = [random.choice(vocabulary) for _ in range([1, 2, 3, 5, 8, 10, 20, 40][k % 8])]
        lines.append(" ".join(base))
        other = list(base)
        for at in random.sample(range(len(base)), 1 + len(base) // 12):
            w = other[at]
            other[at] = random.choice(vocabulary) if k % 3 == 0 else w[:1] + random.choice("0123456789") + w[2:]
        lines.append(" ".join(other))
    links = [(a, b) for a in range(len(lines)) for b in range(a) if 5 * distance(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b]))]
    tops = grouped(range(len(lines)), links)
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(frame(spark, list(enumerate(lines))), radius=None).collect()}
    should = {i for i in range(len(lines)) if any(tops[j] == tops[i] for j in range(i))}
    gone = {i for i, n in out.items() if n}
    assert gone <= should and len(should) > 60 and len(should - gone) <= len(should) // 50, sorted(should - gone)


def test_lines_with_edits_in_many_words_share_parts(spark):
    """Before, with runs of four and five words, 132 of these 200 pairs of lines shared no part."""
    random.seed(21)
    pairs = []
    for k in range(200):
        own = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.choice([2, 3, 5, 6, 8, 9]))) for _ in range(20 + k % 40)]
        at = set(random.sample(range(len(own)), 2 * len(own) // 5))
        other = [w[:1] + "0" + w[2:] if i in at else w for i, w in enumerate(own)]
        pairs.append((" ".join(own), " ".join(other)))
    assert all(similar_pairs(spark, pairs).values())
    keys = lambda c: line_dedup.keys_of(F.split(c, " "), F.length(c))
    assert spark.createDataFrame(pairs, "x string, y string").where(F.arrays_overlap(keys("x"), keys("y"))).count() == 200


def test_lines_with_clashing_columns(spark):
    names = ["doc_id", "text", "n_lines", "n_removed", "removed", "own", "c0", "line"]
    docs = spark.createDataFrame([(1, "one line here\none line here", 5, "x", "y", "z", "c", 7), (None, None, 1, None, None, None, None, None)], "doc_id long, text string, n_lines int, n_removed string, removed string, own string, c0 string, line long")
    out = line_dedup.line_dedup(docs, radius=None)
    assert sorted(out.columns) == sorted(names)
    assert {(r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["own"], r["line"]) for r in out.collect()} == {(1, "one line here", 2, 1, "z", 7), (None, None, 1, 0, None, None)}
    stage = line_dedup.without_repeated_lines(docs, radius=None)
    assert stage.columns == names and {(r["n_lines"], r["n_removed"]) for r in stage.collect()} == {(5, "x"), (1, None)}


def test_lines_of_a_megabyte(spark):
    """Long lines are compared in bounded time: alike but for a few words, and of other words throughout."""
    rng = random.Random(3)
    words_ = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    other = list(words_)
    for at in range(0, len(other), 40):
        other[at] = "x"
    mixed = words_[:20] + [f"v{rng.randrange(10**6)}" for _ in range(120_000)]
    began = time.monotonic()
    out = line_dedup.line_dedup(frame(spark, [(1, " ".join(words_)), (2, " ".join(other)), (3, " ".join(mixed))]), radius=None)
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 1, 3: 0}
    assert time.monotonic() - began < 180


def test_short_lines_are_lines(spark):
    rows = [(1, "and ornd.\nsome other line of this text"), (2, "and ornd.\n\nA\n \n\n"), (3, "a\nand ornd.")]
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()} == {1: rows[0][1], 2: "\nA\n \n\n", 3: ""}


def test_lines_equal_but_for_blanks_and_punctuation(spark):
    rows = [(1, "The tide, at last: it turned"), (2, "the  tide\tat last -- it turned!\r\n---\n***"), (3, "---\r\nother words stand here")]
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()} == {1: rows[0][1], 2: "---\n***", 3: "other words stand here"}


def test_lines_stay_out_of_python(spark):
    plan = line_dedup.line_dedup(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_parts_of_lines_are_never_saved(spark, monkeypatch):
    """They take more room than the lines: before, a table of all lines and one of all forms held them."""
    tables, real = [], line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", lambda df: tables.append(dict(df.dtypes)) or real(df))
    rows = [(i, f"line {i} of some words that stand here\nthe same line of words stands in all of these texts") for i in range(5)]
    assert sum(r["n_removed"] for r in line_dedup.line_dedup(frame(spark, rows), radius=None).collect()) == 8
    assert tables and not any(kind == "array<bigint>" for t in tables for kind in t.values())


def test_lists_at_once_are_the_lists(spark):
    random.seed(6)
    posts = spark.createDataFrame([(random.randrange(60), n, n % 7) for n in range(150)] + [(99, n, 1) for n in range(80)], "key long, node long, weight int")
    once, twice = ({(r["key"], r["node"]): r["pivot"] for r in make(posts).collect()} for make in (linking.lists_at_once, linking.lists_of))
    assert once.keys() == twice.keys() and len(once) > 150
    assert all(pivot == max((n % 7 if k < 99 else 1, n) for j, n in once if j == k)[1] for (k, _), pivot in once.items())


# repeated passages


def plain_removal(rows, length):
    starts = collections.Counter()
    for _, t in rows:
        data = (t or "").encode()
        starts.update(data[k : k + length] for k in range(len(data) - length + 1))
    out = collections.Counter()
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if starts[data[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out[i, len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "hot", "bucket"), [(20, 10**6, 1 << 20), (20, 3, 1 << 20), (20, 1, 1 << 20), (40, 10**6, 2000), (200, 10**6, 1 << 20)])
def test_repeated_passages(spark, length, hot, bucket):
    random.seed(4)
    vocabulary = ["alpha", "béta", "gam", "d", "ee", "zeta"]
    passages = [" ".join(random.choice(vocabulary) for _ in range(random.randint(5, 60))) for _ in range(12)]
    part = lambda: random.choice(passages) if random.random() < 0.6 else " ".join(str(random.random()) for _ in range(4))
    rows = [(i if i % 9 else None, " ".join(part() for _ in range(random.randint(0, 6)))) for i in range(90)]
    rows += [*ODD, (3, rows[3][1]), (502, "ab" * 300), (503, "a" * 900), (504, "x" * 20)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), length, hot, bucket).collect()
    assert collections.Counter(map(tuple, got)) == plain_removal(rows, length)


def test_run_length_index():
    import numpy as np

    for seed in range(30):
        rng = random.Random(seed)
        data = bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(1, 60))) * rng.randint(1, 3)
        array = np.frombuffer(data, np.uint8)
        order = sorted(range(len(data)), key=lambda i: data[i:])
        assert suffix_dedup.suffix_array(array).tolist() == order
        index = suffix_dedup.RunLengthIndex(array)
        assert np.repeat(index.chars, index.sizes).tolist() == [data[i - 1] if i else -1 for i in order]

        def match(i, data=data):
            return max((next((n for n in range(len(data)) if max(i, j) + n >= len(data) or data[i + n] != data[j + n]), 0) for j in range(len(data)) if j != i), default=0)

        assert index.matching_statistics().tolist() == [match(i) for i in range(len(data))]


def test_empty_passages(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, []).limit(0)).count() == 0
