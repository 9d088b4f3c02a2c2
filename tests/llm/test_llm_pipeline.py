"""The pipeline's stages on small inputs, and that the rest of the library works without this subpackage."""

import ast
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

ROOT = Path(__file__).parents[2]


def test_stages(spark):
    import corpus_pipeline
    from emberlog.session import table

    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.materialize(out)
        sizes.append(docs.count())
        if name != "mixing sources to target weights":
            assert sizes[-1] <= sizes[-2]
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}


def test_stages_take_empty_tables(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "emberlog").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(".llm" in n or n == "corpus_pipeline" for n in names), path


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def good_quality(rows):
    """Votes by hand, patterns counted, posteriors by pattern."""
    from emberlog.llm.quality import posteriors

    judged = []
    for r in rows:
        t = r["text"] or ""
        words, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(threes)
        repeats = len({k + j for k, x in enumerate(threes) if often[x] > 1 for j in range(3)})
        n, chars, marks, same, bangs = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), t.count("!")
        bad = [n < 50, repeats > 0.3 * n, marks > 0.02 * chars, marks > 0.2 * n, same >= 3 and same > 0.5 * len(lines), not 3 * n <= chars <= 10 * n, bangs > 0.2 * n]
        fine = [n >= 80, repeats < 0.1 * n, marks < 0.005 * chars, marks < 0.02 * n, same < 0.1 * len(lines), 4 * n <= chars <= 7 * n, bangs < 0.05 * n]
        judged.append((n < 50 or 100 * repeats > 50 * n, sum((0 if b else 2 if f else 1) * 3**k for k, (b, f) in enumerate(zip(bad, fine)))))
    by_pattern, _ = posteriors(Counter(p for _, p in judged), 7)
    return [r for r, (failed, p) in zip(rows, judged) if not failed and by_pattern[p] >= 0.5]


def without_repeated_lines(rows, least=100, alone=30):
    """Every window of `least` characters from and to each line, and each line of `alone`, against all that came before."""
    rows, found = sorted(rows, key=lambda r: r["doc_id"]), []
    for d, r in enumerate(rows):
        lines = r["text"].split("\n")
        ends = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
        spans = {(a, a) for a, x in enumerate(lines) if len(x) >= alone}
        for a in range(len(lines)):
            if (b := next((b for b in range(a, len(lines)) if ends[b + 1] - ends[a] >= least), None)) is not None:
                spans.add((a, b))
            if (b := next((b for b in range(a, -1, -1) if ends[a + 1] - ends[b] >= least), None)) is not None:
                spans.add((b, a))
        found += [(d, a, b, tuple(lines[a : b + 1])) for a, b in spans]
    seen, gone = {}, defaultdict(set)
    for d, a, b, run in sorted(found, key=lambda x: x[:3]):
        if seen.setdefault(run, (d, a)) != (d, a):
            gone[d] |= set(range(a, b + 1))
    out = []
    for d, r in enumerate(rows):
        text = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[d])
        if not gone[d] or WORDS.search(text):
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def first_of_near_copies(rows, k=5):
    sets, root = [], list(range(len(rows)))
    for r in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def mixed(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORDS.findall(r["text"]))
    order = sorted(sizes)
    weight, target, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, sum(sizes.values())
    while len(target) < len(order):
        free = [s for s in order if s not in target]
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        target |= above or share
    out = []
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]]
        draw = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (int(rate) + (draw < rate - int(rate)))
    return out


def test_pipeline_against_brute_force(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline
    from emberlog.session import table

    sf_dir = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in table(spark, sf_dir, "documents").collect()]
    rows = mixed(first_of_near_copies(without_repeated_lines(good_quality(rows))))
    plain, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    for r in rows:
        ids = [*plain.encode(r["text"], add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(spans)) and sum(spans[-1]) <= 1024


def test_stages_take_odd_rows(spark):
    """Nulls, repeated rows and ids, and columns that are called as the stages' own are."""
    import corpus_pipeline

    prose = " ".join(f"word{k} stands here" for k in range(40))
    rows = [(1, prose), (1, prose), (2, prose + " again"), (None, prose + " null"), (3, None), (4, ""), (1, "other " + prose[::-1])]
    names = ["_runs", "_copy", "of_source", "row", "key", "th", "size", "pattern", "counts", "component"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"is {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all(r[c] == f"is {c}" for r in out.collect() for c in names), name
    assert corpus_pipeline.best_fit_packing(spark, docs, "").count() == len(rows)
