"""Packing by histogram, the prefix trie and the Merkle manifest against brute force, on hostile inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, lang, None if i is None else f"s{i % 3}", None if t is None else len(t)) for i, t, lang in rows], DOC)
    return df.withColumns({c: F.lit(c) for c in ("key", "length", "place", "g", "i", "h", "path", "n")})


# Places


@pytest.mark.parametrize("group", [[], ["g"]])
def test_numbered(spark, group):
    from emberlog.llm.ranks import numbered

    rng = random.Random(4)
    rows = [(rng.choice("aaaab"), None if k % 11 == 0 else rng.randrange(30), k, rng.randrange(5)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, k int, v long")
    got = numbered(df.repartition(7), group, ["x", "k"], ["v"]).collect()
    assert len(got) == 500
    ordered = defaultdict(list)
    for g, x, k, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        ordered[g if group else ""].append((k, v))
    want = {k: (p, len(o), sum(v for _, v in o[:p])) for o in ordered.values() for p, (k, _) in enumerate(o)}
    assert {r["k"]: (r["place"], r["n"], r["v_before"]) for r in got} == want
    assert numbered(df.limit(0), group, ["x", "k"], ["v"]).count() == 0


# Packing by a histogram


def test_combinations_fill_a_window():
    from emberlog.llm.nnls import combinations

    lengths = np.array([1, 2, 3, 5, 7, 10, 12])
    got = {tuple(int(x) for x in r if x) for r in combinations(lengths, 17)}
    own = lengths.tolist()
    want = {(a, b) for a in own for b in own if a <= b and a + b == 17} | {(a, b, c) for a in own for b in own for c in own if a <= b <= c and a + b + c == 17}
    assert got == want and (5, 12) in got and (5, 5, 7) in got
    assert {tuple(int(x) for x in r if x) for r in combinations(lengths, 17, 4)} > want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_least_squares_finds_a_histogram_of_combinations(seed):
    from emberlog.llm.nnls import combinations, least_squares, plan

    rng = np.random.default_rng(seed)
    combos = combinations(np.arange(1, 64), 64)
    picked, counts = rng.choice(len(combos), 30, replace=False), np.zeros(65, "int64")
    for k in picked:
        np.add.at(counts, combos[k][combos[k] > 0], int(rng.integers(100, 2000)))
    x = least_squares(combos, counts)
    assert (x >= 0).all()
    made = np.bincount(combos.ravel(), np.repeat(x, 3), 65)
    made[0] = 0
    assert np.abs(made - counts).sum() < 0.02 * counts.sum()
    slots = plan({n: int(c) for n, c in enumerate(counts) if c}, 64)
    covered, spans = 0, defaultdict(list)
    for length, first, stop, _, _ in slots:
        covered += length * (stop - first)
        spans[length].append((first, stop))
    assert covered > 0.95 * (np.arange(65) * counts).sum()
    for length, found in spans.items():  # places of a length are used once, from 0 on, and never beyond its count
        ends = [0, *[b for _, b in sorted(found)]]
        assert [a for a, _ in sorted(found)] == ends[:-1] and ends[-1] <= counts[length]


def test_plan_without_combinations():
    from emberlog.llm.nnls import plan

    assert plan({}, 1024) == [] and plan({1000: 5}, 1024) == [] and plan({600: 4, 500: 4}, 1024) == []
    assert sum(stop - first for _, first, stop, _, _ in plan({512: 7}, 1024)) == 6


@pytest.mark.parametrize("lengths", [[], [5], [63] * 40, [1] * 70, list(range(1, 64)), [33, 40, 50, 60]])
def test_rests_fill_windows_to_the_last(lengths):
    from emberlog.llm.nnls import fill

    got = fill(lengths, 64)
    by_piece, by_sequence = defaultdict(list), defaultdict(list)
    for piece, begin, took, sequence, at in got:
        by_piece[piece].append((begin, begin + took))
        by_sequence[sequence].append((at, at + took))
    for spans, full in ((by_piece, None), (by_sequence, 64)):
        for k, found in spans.items():
            ends = [0, *[b for _, b in sorted(found)]]
            assert [a for a, _ in sorted(found)] == ends[:-1]
            assert ends[-1] == lengths[k] if full is None else (ends[-1] == full or ends[-1] & (ends[-1] - 1) == 0)
    assert set(by_piece) == set(range(len(lengths)))


@pytest.mark.parametrize("max_len,tasks_of", [(16, 50), (64, 10000)])
def test_histogram_packing(spark, max_len, tasks_of):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from emberlog.llm.nnls import pack_by_histogram

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("alpha", "be", "gamma delta", "é", "zz9")) for _ in range(rng.choice((1, 3, 8, 20, 90)))), "en") for i in range(150)]
    rows += [(k, None, "en") for k in range(200, 260)] + [(300, "", "de"), (301, " \n ", "de"), (302, "<|endoftext|> x", "de"), (5, rows[5][1], "en"), (None, "one two", None), (303, "many " * 3000, "en")]
    df = docs(spark, rows)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {}
    for i, t, _ in rows:
        ids[(i, t)] = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    for with_ids in (False, True):
        got = pack_by_histogram(df, max_len, rests_a_task=tasks_of, with_ids=with_ids).collect()
        sequences, covered = defaultdict(list), Counter()
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            whole = [v for (i, _), v in ids.items() if i == r["doc_id"] and len(v) == r["doc_tokens"]][0]
            part = whole[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert not with_ids or list(r["ids"]) == part
            covered.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
        assert covered == Counter((i, k) for i, t, _ in rows for k in range(len(ids[(i, t)])))
        padding = 0
        for placed in sequences.values():
            ends = [0]
            for at, n in sorted(placed):
                assert at == ends[-1]
                ends.append(at + n)
            assert ends[-1] <= max_len
            padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else max_len - ends[-1]
        assert padding == 0
    assert pack_by_histogram(df.limit(0)).count() == 0 and pack_by_histogram(df.limit(0), with_ids=True).count() == 0


def test_histogram_packing_keeps_most_rests_whole(spark):
    from emberlog.llm.nnls import pack_by_histogram

    rng = random.Random(8)
    # 3 to 13 tokens each: every length has a partner in a window of 16.
    got = pack_by_histogram(docs(spark, [(i, "a " * rng.randrange(1, 12), "en") for i in range(2000)]), 16).collect()
    assert {r["doc_tokens"] for r in got} == set(range(3, 14)) and len(got) < 1.02 * 2000


# Prefix trie


def tried(rows):
    """Nodes of the trie of rebuilt conversations, every one by itself."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((n is not None, n or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        s = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[: d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(WORDS.findall(k[-1][1])) if k else 0)
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()]


def conversations(shape):
    rng = random.Random(shape)
    if shape == "odd":  # nulls, ties, repeated rows, a base that is absent or short, conversations that lose all turns
        rows = [(c, t, rng.choice(("user", None, "")), rng.choice(("a", "b b", None, ""))) for c in range(0, 90, 3) for t in rng.sample([None, 0, 1, 2, 5, 5], rng.randrange(1, 6))]
        return [*rows, *rows[:10], (None, 0, "user", "lost"), (40, 0, "user", "short"), (41, 0, "user", "x"), *[(c, 0, "user", "x") for c in range(42, 60)]]
    if shape == "copies":  # one large group of copies beside long ones
        return [(c, t, "user", f"common {t}") for c in range(0, 400) for t in range(3)] + [(c, t, "user", f"{c // 2} {t} long") for c in range(1000, 1004) for t in range(150)]
    if shape == "comb":  # each shares one more turn with the longest, whose prefixes are all nodes where another ends
        return [(c, t, "user", "same words" if t < c % 20 else f"{c} differs") for c in range(20, 40) for t in range(c % 20 + 2)]
    return [(c, t, rng.choice(("user", "assistant")), rng.choice("ab")) for c in range(200) for t in range(rng.randrange(1, 7))]


@pytest.mark.parametrize("shape,block,listed", [("odd", 4096, 1024), ("copies", 16, 7), ("comb", 2, 1024), ("random", 3, 2), ("random", 4096, 1024)])
def test_prefix_trie(spark, monkeypatch, shape, block, listed):
    from emberlog.llm import trie

    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "LISTED", listed)
    rows = conversations(shape)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("depth", "a", "place", "n", "digest")})
    found = trie.prefix_trie(*trie.graft(trie.numbered_turns(df))).collect()
    got = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found]
    assert sorted(got, key=repr) == sorted(tried(rows), key=repr)
    # Preorder: places are unique, a subtree is an interval of them, and intervals nest.
    assert sorted(r["position"] for r in found) == list(range(len(found)))
    stack = []
    for r in sorted(found, key=lambda r: r["position"]):
        while stack and stack[-1] < r["position"]:
            stack.pop()
        assert len(stack) == r["depth"] and all(r["end"] <= e for e in stack)
        stack.append(r["end"])


def test_prefix_trie_of_nothing_and_of_given_turns(spark):
    from emberlog.llm import trie

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.graft(trie.numbered_turns(df.limit(0)))).count() == 0
    turns = trie.numbered_turns(df)
    got = {(r["conv_id"], r["depth"]): (r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in trie.prefix_trie(turns, trie.members_of(turns)).collect()}
    assert got == {(1, 0): (2, 1, 1), (1, 1): (2, 1, 1), (1, 2): (1, 1, 0)}


# Merkle manifest


def merkle(rows, fan):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of each row."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def hashed(s):
        return hashlib.sha256(s.encode()).hexdigest()

    def leaf(r):
        return hashed("".join("-" if r[k] is None else f"{len(str(r[k]).encode())}:{r[k]}" for k in ("doc_id", "source", "lang", "n_chars", "text")))

    def build(row):
        paths, at = [[] for _ in row], list(range(len(row)))
        while len(row) > 1:
            for k, a in enumerate(at):
                run = row[a // fan * fan : a // fan * fan + fan]
                paths[k].append((run[: a % fan], run[a % fan + 1 :]))
            at = [a // fan for a in at]
            row = [hashed("".join(row[a : a + fan])) for a in range(0, len(row), fan)]
        return row[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    built = {g: build([leaf(r) for r in groups[g]]) for g in order}
    root, above = build([built[g][0] for g in order])
    out = []
    for g, more in zip(order, above):
        for r, path in zip(groups[g], built[g][1]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            h = leaf(r | {"text": r["text"].translate(str.maketrans(upper, lower))}) if hit else leaf(r)
            for left, right in path + more:
                h = hashed("".join(left) + h + "".join(right))
            out.append((r["doc_id"], leaf(r), built[g][0], root, hashed("".join("".join(a) + "".join(b) for a, b in path + more)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,langs,fan", [(1, 1, 8), (2, 2, 8), (9, 1, 8), (70, 12, 8), (73, 3, 2), (130, 2, 8)])
def test_manifest(spark, n, langs, fan):
    from emberlog.llm.merkle import lowered, manifest, verified

    rng = random.Random(n)
    rows = [(rng.randrange(-5, 1 << 40), rng.choice((None, "", "Some TEXT é", "lower", f"Text {k}")), None if k % langs == 1 else f"l{k % langs}é") for k in range(n)]
    rows += [(None, "NO Id", "x"), (None, None, None), rows[0], rows[0]] if n > 60 else []
    df = docs(spark, rows)
    want = merkle([r.asDict() for r in df.collect()], fan)
    found = verified(manifest(df, lowered(), fan)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_manifest_of_nothing_and_untampered(spark):
    from emberlog.llm.merkle import lowered, manifest, verified

    df = docs(spark, [(k, f"Text {k}", "en") for k in range(20)])
    assert verified(manifest(df.limit(0), lowered())).count() == 0
    assert verified(manifest(df)).where("NOT verified").count() == 0
    # One changed character is found, wherever it stands.
    changed = verified(manifest(df, F.when(F.col("doc_id") == 13, F.lit("Text 13.")).otherwise(F.col("text"))))
    assert [r["doc_id"] for r in changed.where("NOT verified").collect()] == [13]
