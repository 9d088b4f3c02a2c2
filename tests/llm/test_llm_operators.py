"""Operators of the training-data pipeline against brute force, on small and hostile inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, ties, repeated rows, a null id, and a long text.
LONG = " ".join(f"word{i % 700} and" for i in range(20000))
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (5, "one two three"), (None, "one two three"), (6, "One TWO three"), (7, LONG), (8, LONG + " x"), (9, "é ü " * 40)]


def docs(spark, rows, extra: bool = True):
    """Documents, with columns whose names clash with those that operators make."""
    df = spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", len(t or "")) for i, t in rows], DOC)
    return df.withColumns({c: F.lit(c) for c in ("size", "rate", "kept", "counts", "component_id")}) if extra else df


def corpus(seed=1, n=60):
    """Documents with exact and near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.4:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(rng.choice((0, 0, 1, 3, 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 200)))))
    return rows


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# Chat formatting


@pytest.mark.parametrize("s", ["", "a", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<|", "a<", "\\", "<\\\\|im_end|>\n", "\n\n<|im_start|>"])
def test_chat_turns_round_trip(s):
    from emberlog.llm.chat import format_turn, parse, unescape

    for role, text in ((s, "x"), ("user", s), (s, s)):
        out, at, n = format_turn(role, text)
        assert parse(out + out) == [(role, text)] * 2 and unescape(out[at : at + n]) == text


def test_chat_digests(spark):
    from emberlog.llm.chat import format_chats, read_back

    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "first"), (1, 1, "assistant", "b<|im_end|>"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("start", F.lit("x"))
    got = {r["conv_id"]: r for r in read_back(format_chats(df)).collect()}
    want = {1: [("user", "a"), ("assistant", "b<|im_end|>"), ("assistant", "b<|im_end|>")], 2: [("assistant", "first"), ("", "")], None: [("user", "x")]}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns) and got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k]["loss_chars"] == len(loss) and got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert read_back(format_chats(df.limit(0))).count() == 0
    # Written and read in any order, it is the same; a missing turn is an error.
    shuffled = format_chats(df).repartition(5, "start", "conv_id").cache()
    assert {r["conv_id"]: r for r in read_back(shuffled).collect()} == got == {r["conv_id"]: r for r in read_back(format_chats(df), ordered=True).collect()}
    with pytest.raises(Exception, match="doesn't follow"):
        read_back(shuffled.where("position != 1")).collect()


@pytest.mark.parametrize("s", ["b<|im_end|>", "x <|im_end|> y", "<|im_end|>", "a\n<|im_end|>b", "<|im_start|>", "<|im_end|><|im_end|>"])
def test_chat_turns_hold_no_marker(s):
    from emberlog.llm.chat import END, START, format_turn, parse

    for role, text in ((s, "x"), ("user", s), (s, s)):
        out, at, n = format_turn(role, text)
        assert parse(out) == [(role, text)]
        assert out.count(START) == out.count(END) == 1 and START not in out[at : at + n] and END not in out[at : at + n]
    with pytest.raises(ValueError):
        parse(f"{START}user\nx {END} y{END}\n")


# Line dedup


def deduped(rows, least=100):
    """Every window from each line and to each line, compared with all that came before."""
    seen, deleted = {}, defaultdict(set)
    ordered = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    found = []
    for d, (i, t) in enumerate(ordered):
        lines = t.split("\n")
        spans = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += len(lines[b]) + 1
                if total >= least:
                    spans.add((a, b))
                    break
            total = 0
            for b in range(a, -1, -1):
                total += len(lines[b]) + 1
                if total >= least:
                    spans.add((b, a))
                    break
        found += [((d, a), b, tuple(lines[a : b + 1])) for a, b in spans]
    for place, b, run in sorted(found):
        if seen.setdefault(run, place) != place:
            deleted[place[0]] |= set(range(place[1], b + 1))
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in deleted[d]) for d, (i, t) in enumerate(ordered)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(spark, seed):
    from emberlog.llm.linededup import dedup_lines

    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcde ") for _ in range(rng.choice((0, 3, 20, 45, 60, 120)))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 15)))) for i in range(40)] + [(100, None), (101, ""), (3, "again"), (3, "again")]
    want = deduped(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("h", F.col("text"))
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "_runs"] and out.count() == len(rows)
    for r in out.collect():
        assert r["text"] == (None if r["h"] is None else want[(r["doc_id"], r["h"])])
    assert dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_takes_whole_passages(spark):
    from emberlog.llm.linededup import dedup_lines

    passage = "\n".join(f"p{k} " + "x" * 30 for k in range(4))
    rows = [(1, f"intro one\n{passage}\nend"), (2, f"other\n{passage}"), (3, f"{passage}\nmore\n{passage}"), (4, "short line\nend")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other", 3: "more", 4: "short line\nend"}


def test_the_query_leaves_no_repeated_line(spark, tmp_path):
    """The registered query takes lines of 30 characters or more by themselves, whatever stands beside them."""
    from emberlog.llm.catalogue import QUERIES

    told = "this one line of boilerplate stands everywhere"
    rows = [(i, f"{i} {i}\n{told}\n{i * 7} {i}", "en", "s", 1) for i in range(12)] + [(50, "a\nb", "en", "s", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["kept_sha256"]) for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    kept = {i: t if i in (0, 50) else t.replace(f"{told}\n", "") for i, t, *_ in rows}
    assert got == {i: (t.count("\n") + 1, int(i not in (0, 50)), hashlib.sha256(kept[i].encode()).hexdigest()) for i, t, *_ in rows}


def test_line_dedup_takes_single_lines(spark):
    """Lines of 30 characters go whatever stands beside them; shorter ones stay."""
    import corpus_pipeline
    from emberlog.llm.linededup import dedup_lines

    notice, edge, short = "Subscribe to our letter and never miss any news!!!", "e" * 30, "s" * 29
    assert len(notice) == 50
    rows = [(k, f"{notice}\nown {k}\n{edge}\nmine {k}\n{short}\nlast {k}\n{notice if k % 2 else k}") for k in range(1, 6)] + [(9, notice)]
    df = docs(spark, rows, extra=False)
    want = {1: "\n".join(rows[0][1].split("\n")[:-1])} | {k: f"own {k}\nmine {k}\n{short}\nlast {k}" + ("" if k % 2 else f"\n{k}") for k in range(2, 6)} | {9: ""}
    assert {r["doc_id"]: r["text"] for r in dedup_lines(df, line_chars=30).collect()} == want
    del want[9]
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == want


def test_line_dedup_keeps_columns_of_any_name(spark):
    """Null ids, a very long text, and columns that are called as the operator's own are."""
    from emberlog.llm.linededup import dedup_lines

    passage, long = "\n".join(f"p{k} " + "x" * 40 for k in range(3)), "\n".join(f"line {k} of many that differ" for k in range(30000))
    rows = [(None, passage), (1, passage + "\nown"), (None, "alone"), (2, long), (3, long + "\n" + passage)]
    names = ["_id", "_th", "_of", "_runs", "key", "runs", "row", "th", "start", "h"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"is {c}") for c in names})
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "__runs"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(None, passage), (1, "own"), (None, "alone"), (2, long), (3, "")])
    assert all(r[c] == f"is {c}" for r in got for c in names)


# Mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what lies above the limit is shared out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        rest, sum_w = total - sum(fixed.values()), sum(w[s] for s in free)
        share = {s: rest * w[s] / sum_w for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 0, "b": 7}, {"a": 1}, {f"s{k}": (k * 37) % 101 for k in range(11)}])
def test_mixing_targets(spark, sizes):
    from emberlog.llm.mixing import source_rates

    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    want = targets(sizes)
    for r in source_rates(df).collect():
        assert r["target"] == pytest.approx(want[r["source"]]) and r["target"] <= 3 * r["source_size"] + 1e-9


def test_mixing(spark):
    from emberlog.llm.mixing import mix, plan_mix

    df = docs(spark, HARD + [(k, "a b c") for k in range(20, 420)])
    plan = plan_mix(df).collect()
    assert len(plan) == len(HARD) + 400
    for r in plan:
        assert int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 and r["copies"] <= 3
    small = plan_mix(docs(spark, [(k, "a b c") for k in range(2000)])).collect()
    for s in {r["source"] for r in small}:
        own = [r for r in small if r["source"] == s]
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(own[0]["target"], rel=0.1)
    mixed = mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in plan)
    names = ["_copy", "of_source", "size", "_size", "copies", "of", "row", "col"]
    clash = df.withColumns({c: F.lit(f"is {c}") for c in names})
    mixed = mix(clash)
    assert mixed.columns == clash.columns and mixed.count() == sum(r["copies"] for r in plan) == mixed.where(" AND ".join(f"`{c}` = 'is {c}'" for c in names)).count()
    assert plan_mix(clash).count() == len(plan)
    assert mix(df.limit(0)).count() == 0


def test_mixing_reaches_its_targets_without_ids(spark):
    from emberlog.llm.mixing import mix, plan_mix

    rows = [(None, f"some text {k} " + "w " * (k % 5), "en", "aabbbbbbbbbbbbccccccc"[k % 21], 1) for k in range(4000)]
    df = spark.createDataFrame(rows, DOC)
    plan = plan_mix(df).collect()
    for s in "abc":
        own = [r for r in plan if r["source"] == s]
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(own[0]["target"], rel=0.1)
    assert mix(df).count() == sum(r["copies"] for r in plan)


# Near-dedup


def similar(rows, k, percent=80):
    sets = []
    for i, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            links.append((rows[a][0], rows[b][0]))
    return sets, links


@pytest.mark.parametrize(("k", "stretch"), [(2, 4096), (5, 4096), (2, 2)])
def test_near_duplicates(spark, k, stretch):
    from emberlog.llm.neardup import first_of_group, link_documents

    rows = corpus() + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, LONG), (1006, LONG + " more")]
    sets, links = similar(rows, k)
    want = components_of([i for i, _ in rows], links)
    got = {r["doc_id"]: r for r in link_documents(docs(spark, rows), k, stretch=stretch).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (i == want[i]) for (i, _), s in zip(rows, sets))
    df = docs(spark, rows)
    kept = first_of_group(df, k)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_hard_rows(spark):
    from emberlog.llm.neardup import link_documents

    got = link_documents(docs(spark, HARD), 2).collect()
    assert len(got) == len(HARD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["component_id"] for r in by[5]] == [5, 5] and by[6][0]["component_id"] == 5 and by[None][0]["component_id"] == 5
    assert by[1][0]["n_shingles"] == 0 and by[1][0]["kept"] and by[8][0]["component_id"] == 7
    assert link_documents(docs(spark, HARD).limit(0), 2).count() == 0
    assert link_documents(docs(spark, [(1, None)]), 2).first()["kept"]


def test_repeated_ids_and_null_ids_keep_one_row_of_each_group(spark):
    from emberlog.llm.neardup import first_of_group, link_documents

    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (3, b), (5, b), (7, c), (7, c), (None, c), (None, a + " more"), (None, "x y"), (None, "x y"), (8, None), (8, None), (9, "")]
    want = Counter([(5, a), (3, b), (7, c), (None, a + " more"), (None, "x y"), (8, None), (8, None), (9, "")])
    for stretch in (4096, 2):
        kept = first_of_group(docs(spark, rows).withColumn("key", F.lit(1)).withColumn("th", F.lit("x")), 2, stretch=stretch)
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    got = Counter((r["doc_id"], r["component_id"]) for r in link_documents(docs(spark, rows), 2).collect())
    assert got == Counter([(5, 5), (3, 3), (5, 3), (7, 7), (7, 7), (None, 7), (None, None), (None, None), (None, None), (8, 8), (8, 8), (9, 9)])
    assert first_of_group(docs(spark, rows).limit(0)).count() == 0


def test_unrelated_long_documents_share_no_prefix(spark):
    """A prefix keeps all of its bits, however long a text is."""
    from emberlog.llm.neardup import sketches

    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(20000)), lambda x: F.concat_ws("_", "id", x.cast("string")))).alias("text"))
    rows = sketches(df, 2).select(F.posexplode("keys").alias("t", "k"))
    assert rows.groupBy("t", "k").count().where("count > 1").count() == 0


def test_regions_of_one_group_and_of_many(spark):
    """A dense prefix is cut into stretches: a big group becomes one component, and groups apart stay apart."""
    from emberlog.llm.neardup import link_documents

    rng = random.Random(8)
    shared = [f"s{k}" for k in range(300)]
    rows = []
    for i in range(120):
        own = [f"g{i % 4}_{k}" for k in range(90 if i % 4 else 0)]
        w = shared + own
        w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    want = components_of([i for i, _ in rows], similar(rows, 2)[1])
    assert {r["doc_id"]: r["component_id"] for r in link_documents(docs(spark, rows), 2, stretch=10).collect()} == want


def test_star_of_copies_is_one_component(spark):
    """Copies that are similar to the original alone must all be found, however many they are."""
    from emberlog.llm.neardup import link_documents

    rng = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for p in rng.sample(range(200), 9):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    want = components_of([i for i, _ in rows], similar(rows, 2)[1])
    assert {r["doc_id"]: r["component_id"] for r in link_documents(docs(spark, rows), 2).collect()} == want


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    from emberlog.llm.components import components

    rng = random.Random(3)
    edges = {"chain": [(k, k + 1) for k in range(60)], "star": [(99, k) for k in range(60)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]}[shape] + [(7, 7), (None, 3)]
    proper = [(a, b) for a, b in edges if a is not None and a != b]
    want = components_of({x for e in proper for x in e}, proper)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


# Embeddings


def test_cover_tree(spark):
    from emberlog.llm.covertree import link_vectors

    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    rows = [(i, (centers[rng.integers(30)] + rng.normal(size=16) * rng.choice((0.02, 0.15, 1.0))).astype("float32").tolist()) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, rows[5][1]), (1006, [2 * x for x in rows[5][1]])]
    good = [(i, np.array(v, "float64")) for i, v in rows if i < 1000 or i > 1004]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    links = [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(np.triu(hit)))]
    want = components_of([i for i, _ in rows], links)
    counts = Counter(z for pair in links for z in pair)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("unit", F.lit(1)).withColumn("name", F.lit(2))
    got = link_vectors(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (counts[i], want[i], want[i] == i) for i in want}
    assert link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block,fan,depth", [(20, 3, 8), (20, 3, 2), (50, 256, 8), (10000, 4, 8)])
def test_cover_tree_levels(spark, monkeypatch, block, fan, depth):
    """Cells within cells, cells cut by hash at the last level, tight cells and pairs that are taken whole: all links of brute force."""
    from emberlog.llm import covertree

    for name, value in (("BLOCK", block), ("FAN", fan), ("DEPTH", depth)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 12))
    tight = centers[0] + rng.normal(size=(150, 12)) * 0.003
    wider = np.repeat(centers[1:], 40, axis=0) + rng.normal(size=(200, 12)) * rng.choice((0.05, 0.2), size=(200, 1))
    x = np.concatenate([tight, wider, rng.normal(size=(100, 12)), tight[:30]])
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    want = components_of(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(hit)))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.link_vectors(df).collect()}
    assert got == {7 * i: (hit[i].sum(), 7 * want[i]) for i in range(len(x))}


def test_cover_tree_copies_are_bounded(spark, monkeypatch):
    """Vectors along a circle: a vector goes to cells around it alone, and those of one tight group meet in no task."""
    from emberlog.llm import covertree

    monkeypatch.setattr(covertree, "BLOCK", 20)
    monkeypatch.setattr(covertree, "FAN", 8)
    turn = np.concatenate([np.arange(1200) * 2 * np.pi / 1200, 1 + np.arange(300) * 1e-5])
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    nodes = spark.createDataFrame([(bytes([i // 256, i % 256]), v.tobytes(), 1, covertree.ROOT) for i, v in enumerate(x)], "node binary, unit binary, weight long, cell string")
    vectors, cells, pairs = covertree._upper_tree(nodes, len(x), x[0].tobytes(), 0.1**0.5)
    assert vectors.count() == len(x) == cells.agg(F.sum("n")).first()[0] and cells.count() >= 20
    meets = covertree._both_ways(pairs.where("NOT whole"), cells)
    copies = vectors.join(meets, "cell").groupBy("node").count().agg(F.max("count")).first()[0]
    assert (copies or 0) <= 10
    assert pairs.where("whole AND i = j").join(cells, F.col("i") == F.col("cell")).agg(F.max("n")).first()[0] >= 300


@pytest.mark.parametrize("scale", [0.001, 0.05, 0.2, 1.0])
def test_dual_traversal(scale):
    from emberlog.llm.covertree import DualTraversal

    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(20, 8)), 40, axis=0) + rng.normal(size=(800, 8)) * scale
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b, w = x[::2], x[1::2], np.ones(400, "int64")
    hit = a @ b.T >= 0.9
    pair = DualTraversal(0.9, a, w, b, w)
    assert (pair.counts[0] == hit.sum(1)).all() and (pair.counts[1] == hit.sum(0)).all()
    want = components_of(range(800), [(i, 400 + j) for i, j in zip(*np.nonzero(hit))])
    got = components_of(range(800), [(int(p), int(q)) for u, v in pair.links for p, q in zip(u, v)])
    assert got == want


def test_matrix_of_mixed_lengths():
    """Inner products are those of the whole vectors, and one long vector adds few columns."""
    from emberlog.llm.covertree import WIDE, _matrix

    rng = np.random.default_rng(8)
    lengths = [4] * 1500 + [WIDE, WIDE + 1, 3000, 5000, 5001] + [1500] * 700 + [1_000_000] * 2
    rows = [rng.normal(size=n) for n in lengths]
    rows.append(np.concatenate([rows[-1][:900_000], rng.normal(size=100_000)]))
    rows = [x / np.linalg.norm(x) for x in rows]
    got = _matrix([x.tobytes() for x in rows])
    assert got.shape == (len(rows), got.shape[1]) and got.shape[1] < 3 * WIDE
    for i in (0, 1499, 1500, 1501, 1502, 1503, 1504, 1600, len(rows) - 3, len(rows) - 1):
        want = [x[: len(rows[i])] @ rows[i][: len(x)] for x in rows]
        assert np.allclose(got @ got[i], want, rtol=0, atol=1e-12)
    short = [np.arange(1.0, n) for n in (3, 9, 5)]
    assert (_matrix([x.tobytes() for x in short]) == np.array([np.pad(x, (0, 8 - len(x))) for x in short])).all()


@pytest.mark.parametrize("block", [8192, 40])
def test_cover_tree_mixed_lengths(spark, monkeypatch, block):
    """Short vectors are the heads of long ones, one has a million components; ids are null or repeat; as brute force has it."""
    from emberlog.llm import covertree

    monkeypatch.setattr(covertree, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = [rng.normal(size=n) for n in (6, 6, 1500, 2500, 5000)]
    x = [b + rng.normal(size=len(b)) * scale for b in base for scale in (0.01, 0.1, 0.4) for _ in range(6)]
    x += [np.concatenate([b, rng.normal(size=3000) * scale]) for b in base for scale in (1e-3, 1e-2, 0.1)]
    x += [np.concatenate([x[0], np.zeros(20), rng.normal(size=1_000_000) * 1e-4]), x[0], np.concatenate([x[1], np.zeros(4000)])]
    ids = list(range(len(x)))
    ids[3], ids[40], ids[41] = None, 39, None
    width = max(map(len, x))
    hit = np.zeros((len(x), len(x)), bool)
    units = [v / np.linalg.norm(v) for v in x]
    for i, u in enumerate(units):
        for j, v in enumerate(units):
            n = min(len(u), len(v))
            hit[i, j] = i != j and u[:n] @ v[:n] >= 0.95
    of = components_of(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(hit)))])
    least = {}
    for i in range(len(x)):
        if ids[i] is not None:
            least[of[i]] = min(least.get(of[i], ids[i]), ids[i])
    want = Counter((ids[i], int(hit[i].sum()), least.get(of[i])) for i in range(len(x)))
    assert width > 1_000_000 and hit.any()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in covertree.link_vectors(df).collect())
    assert got == want


# Licenses


def test_licenses(spark):
    from emberlog.llm.licenses import TEMPLATES, TemplateIndex, needed, scan_licenses, words_of

    rows = HARD + [(20, "x\nReleased under the MIT License.\nAll Rights reserved"), (21, "General\nPublic license, cc by-nc"), (22, "You must permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files deal in software")]
    got = {r["doc_id"]: r for r in scan_licenses(docs(spark, rows)).collect()}
    assert got[20]["base_labels"] == "reserved" and "notice-mit" in got[20]["labels"] and (got[20]["first_word"], got[20]["n_base"]) == (6, 1)
    assert got[21]["base_labels"] == "cc-by,gpl" and got[21]["score"] == 1.0
    assert "grant-mit" in got[22]["labels"] and 0.8 <= got[22]["score"] < 1
    assert got[1]["n_words"] == 0 and got[1]["first_word"] is None and got[1]["labels"] == ""
    rng = random.Random(1)
    pool = sorted({w for _, t in TEMPLATES for w in words_of(t)})
    index = TemplateIndex(TEMPLATES, {w: rng.randrange(50) for w in pool}, 0.8)
    for _ in range(3000):
        _, base = rng.choice(TEMPLATES)
        block = {w for w in words_of(base) if rng.random() < 0.85} | set(rng.sample(pool, rng.randrange(4)))
        want = sorted((t, len(set(words_of(x)) & block)) for t, (_, x) in enumerate(TEMPLATES) if len(set(words_of(x)) & block) >= needed(len(set(words_of(x))), 0.8))
        assert index.matches(block) == want


MIT = """/*
 * Copyright (c) 2020 Somebody
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 */
int main;"""


def test_wrapped_licenses(spark):
    from emberlog.llm.licenses import CONTAINMENT, NAMED, TEMPLATES, needed, scan_licenses, words_of

    short = "x y\nReleased under\nthe MIT License.\nz"
    rows = [(1, MIT), (2, short), (3, MIT + "\n" + "filler words\n" * 30 + MIT), (4, MIT.replace(" free of charge, to any person obtaining", " " + "x " * 40)), (5, "Released under the MIT License.\n" + "filler words\n" * 9 + short), (6, "Released under the MIT License.\n" + short[4:] + "\nReleased under the MIT License.")]
    rows += [(100 + k, "\n".join(words_of(text))) for k, (_, text) in enumerate(TEMPLATES)]
    got = {r["doc_id"]: r for r in scan_licenses(docs(spark, rows)).collect()}
    blocks = {i: [(b["line"], b["label"]) for b in r["blocks"]] for i, r in got.items()}
    assert "grant-mit" in got[1]["labels"] and blocks[1] == [(3, "grant-mit")] and 0.8 <= got[1]["score"] <= 1
    assert blocks[2] == [(1, "notice-mit")] and got[2]["score"] == 1.0
    assert blocks[3] == [(3, "grant-mit"), (42, "grant-mit")] and blocks[4] == []
    assert blocks[5] == [(0, "notice-mit"), (11, "notice-mit")]
    assert blocks[6] == [(0, "notice-mit"), (1, "notice-mit"), (4, "notice-mit")]
    for k, (label, _) in enumerate(TEMPLATES):
        assert label in got[100 + k]["labels"].split(",")
    # Labels of scattered words, against each line that is no longer than a window, and each window of each template's width.
    rng = random.Random(3)
    pool = sorted({w for _, t in TEMPLATES for w in words_of(t)}) + ["filler"] * 20
    rows = []
    for i in range(150):
        words = [w for _ in range(3) for w in [*rng.choices(pool, k=rng.randrange(30)), *(w for w in words_of(rng.choice(TEMPLATES)[1]) if rng.random() < 0.9)]]
        rows.append((i, "".join(w + rng.choice(" \n") for w in words)))
    for r in scan_licenses(docs(spark, rows)).collect():
        text, want = rows[r["doc_id"]][1], set()
        words, lines = words_of(text), [words_of(x) for x in text.split("\n")]
        for label, t in TEMPLATES:
            own, width = set(words_of(t)), -(-len(words_of(t)) * 10 // round(CONTAINMENT * 10))
            must, never = NAMED.get(label, ((), ()))
            # A window begins and ends with words of the template.
            spans = [words[a:b] for a in range(len(words)) for b in range(a + 1, min(a + width, len(words)) + 1) if words[a] in own and words[b - 1] in own]
            if any(len(own & set(b)) >= needed(len(own), CONTAINMENT) and set(must) <= set(b) and not set(never) & set(b) for b in [*(x for x in lines if len(x) <= width), *spans]):
                want.add(label)
        assert {b["label"] for b in r["blocks"]} == want


def test_no_license_is_taken_for_its_sibling(spark):
    from emberlog.llm.licenses import scan_licenses

    others = ["Released under the GPL License.", "Released under the BSD License.", "Licensed under the Apache License, Version 1.0.", "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC-SA 4.0.", "He reserved all the rights to the car", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"]
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"
    scattered = " ".join(f"{w} far apart from it" for w in grant.split())
    right = {"Released under the MIT License.": "notice-mit", "Licensed under the Apache License, Version 2.0.": "notice-apache-2.0", "Licensed under CC BY-NC 4.0.": "notice-cc-by-nc-4.0", "words before it " * 9 + grant + " and words after it" * 9: "grant-mit", "This work is licensed under the GNU General Public License, version 3.": "notice-gpl-3.0"}
    texts = [*others, *[x.replace(" ", "\n", 3) for x in others], scattered, *right, *[x.replace("License", "\nLicense") for x in right]]
    got = {texts[r["doc_id"]]: {b["label"] for b in r["blocks"]} for r in scan_licenses(docs(spark, list(enumerate(texts)))).collect()}
    for t in texts:
        assert got[t] == ({right[t.replace("\nLicense", "License")]} if t.replace("\nLicense", "License") in right else set()), t


# Secrets


def test_a_blob_that_two_writers_have_added_counts_once(spark, tmp_path):
    from emberlog.llm.secrets import find_secrets, update_ledger

    ledger, text = f"file://{tmp_path}/ledger", "token = abcdefghijklmnop"
    df = docs(spark, [(1, text), (2, text), (3, "none")])
    blobs = df.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    update_ledger(blobs, ledger)
    update_ledger(blobs, f"{ledger}-2")
    spark.read.parquet(f"{ledger}-2").write.mode("append").partitionBy("rule_version").parquet(ledger)
    got = find_secrets(df, ledger).collect()
    assert sorted((r["doc_id"], len(r["spans"])) for r in got) == [(1, 1), (2, 1), (3, 0)]


def test_secrets(spark, tmp_path):
    from emberlog.llm.secrets import digest, find_secrets, read_ledger

    key = "AKIA" + "Q" * 16
    rows = HARD + [(20, f"é password = 'abcdefghijkl' {key} then 0123456789abcdef0"), (21, f"é password = 'abcdefghijkl' {key} then 0123456789abcdef0"), (22, "secret: token: abcdefghijklmnop TOKEN:'x'"), (23, "API_KEY=" + "z" * 5000)]
    ledger = f"file://{tmp_path}/ledger"
    got = {r["doc_id"]: r for r in digest(find_secrets(docs(spark, rows), ledger)).collect()}
    assert got[20]["spans"] == "assign:2:26,access:28:48,hex:54:71" == got[21]["spans"]
    assert (got[22]["n_assign"], got[23]["spans"], got[1]["spans"]) == (0, "assign:0:5008", "")
    blobs = read_ledger(spark, ledger, 1).count()
    assert blobs == len({t or "" for _, t in rows})
    again = find_secrets(docs(spark, rows + [(30, "new")]), ledger)
    assert again.count() == len(rows) + 1 and read_ledger(spark, ledger, 1).count() == blobs + 1
    find_secrets(docs(spark, rows), ledger, version=2)
    assert read_ledger(spark, ledger, 2).count() == blobs and read_ledger(spark, ledger, 1).count() == blobs + 1
    assert find_secrets(docs(spark, rows).limit(0), ledger).count() == 0


# WARC


def test_warc(spark, tmp_path):
    from emberlog.llm.warc import archived_pages, read_records, write_archives

    big = "ü\r\n\r\nWARC/1.1" * 30
    rows = [(3, "http://a/ b", big), (1, None, big), (2, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 3_000_000), (8, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("offset", F.lit(1))
    got = sorted(archived_pages(df).collect(), key=lambda r: r["page_id"])
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (8, "response", None)]
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(r["payload_bytes"] == len(html[r["page_id"]]) and r["payload_digest"] == hashlib.sha256(html[r["page_id"]]).hexdigest() for r in got)
    folder = f"file://{tmp_path}/w"
    index = write_archives(df, folder, file_bytes=200)
    assert index.select("file").distinct().count() > 1
    chosen = read_records(index.where("page_id IN (1, 4)"), folder).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in chosen} == {1: html[1], 4: html[4]}
    assert archived_pages(df.limit(0)).count() == 0
    assert [r["record_type"] for r in archived_pages(spark.createDataFrame([(None, None, big), (None, "u", big)], "page_id long, url string, html string")).collect()] == ["response"] * 2


def test_warc_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    from emberlog.llm import warc

    monkeypatch.setattr(warc, "TASK_BYTES", 2000)
    rng = random.Random(1)
    rows = [(k, "u", "".join(rng.choice("abcdefgh") for _ in range(900))) for k in range(60)]
    folder = f"file://{tmp_path}/w"
    read = warc.read_records(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder), folder)
    assert read.rdd.getNumPartitions() > 8 and {r["page_id"]: bytes(r["payload"]).decode() for r in read.collect()} == {i: h for i, _, h in rows}


# Quality


def test_quality_counts(spark):
    from emberlog.llm.quality import counts, judge, keep_good

    rng = random.Random(2)
    rows = HARD + [(k, "\n".join(" ".join(rng.choice("a b c d e f#g").split(" ")[0] for _ in range(rng.randrange(9))) for _ in range(rng.randrange(30)))) for k in range(50, 90)] + [(k, " ".join(rng.choice(["aa", "bb", "cc", "d!"]) for _ in range(rng.randrange(400)))) for k in range(90, 120)]
    want = Counter()
    for i, t in rows:
        t = t or ""
        w = WORDS.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))] += 1
    df = docs(spark, rows)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in counts(df).collect())
    assert got == want
    judged = judge(df).collect()
    assert all(not r["kept"] for r in judged if r["base_failed"])
    kept = keep_good(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in judged if r["kept"])
    assert judge(df.limit(0)).count() == 0 and keep_good(df.limit(0)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    from emberlog.llm.quality import posteriors

    rng = random.Random(1)
    right = [(0.95, 0.8), (0.9, 0.7), (0.97, 0.6)]
    seen, truth = Counter(), defaultdict(Counter)
    for _ in range(20000):
        good = rng.random() < 0.8
        p = sum((1 if rng.random() < 0.1 else 2 * int((rng.random() < right[k][0]) if good else (rng.random() >= right[k][1]))) * 3**k for k in range(3))
        seen[p] += 1
        truth[p][good] += 1
    by_pattern, rows = posteriors(seen, 3)
    ok = sum(truth[p][by_pattern[p] >= 0.5] for p in seen)
    assert ok / 20000 > 0.9
    assert all(abs(rows[k][0][2] / (rows[k][0][0] + rows[k][0][2]) - right[k][0]) < 0.05 for k in range(3))


def test_quality_on_labels(spark):
    """Junk by the labels is rejected, and what the base rules pass of good documents stays."""
    from emberlog.llm.quality import judge
    from emberlog.session import table

    labels = table(spark, "/root/testdata/sf0.01", "labels")
    judged = judge(table(spark, "/root/testdata/sf0.01", "documents")).join(labels, "doc_id").collect()
    good = [r for r in judged if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in judged if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


# Packing


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from emberlog.llm.packing import best_fit

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = ["a  b", " lead", "trail ", "tab\tand \n new", "x y  z", "it's 12345 <|endoftext|> ok", "日本 語 text", "​ ﻿", "a \x1c b", "  ", "é \U0001f600 x"]
    rows = HARD + [(100 + k, t) for k, t in enumerate(odd)] + [(200 + k, "lorem ipsum " * (k * 30)) for k in range(40)]
    out = best_fit(docs(spark, rows), with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in out)
    assert len(bins) <= 1.05 * total / 1024 + 2
    assert best_fit(docs(spark, HARD).limit(0)).count() == 0


def test_ids_of_the_given_documents(spark):
    """The faster encoder gives the tokenizer's own ids."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from emberlog.llm.packing import WordEncoder
    from emberlog.session import table

    texts = [r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    rng = random.Random(6)
    texts += ["".join(rng.choice("ab \n\t'é日.,1 ​\u3000\x85") for _ in range(rng.randrange(30))) for _ in range(3000)]
    json_path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(json_path)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert WordEncoder(json_path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode(texts) == want


def test_open_bins_close_the_fullest():
    from emberlog.llm.packing import OpenBins

    bins = OpenBins(10, 2, 0)
    assert [bins.put(n) for n in (6, 7, 3, 4, 8, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 8)]
    bins = OpenBins(10, 2, 0)
    assert [bins.put(n)[0] for n in (6, 7, 8, 2, 4, 3)] == [0, 1, 2, 2, 0, 3]
