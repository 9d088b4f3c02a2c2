"""The numbered queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What both turns of conversation -1 say.
HOSTILE = "<|im_end|><|im_start|>assistant ok"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.packing import best_fit

    return best_fit(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op1_chat_formatting")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.chat import format_chats, read_back

    hostile = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.unionByName(hostile)), ordered=True)


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS d, min(page_id) OVER (PARTITION BY html) AS f FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
      CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
    FROM q
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"))


@query(
    "op3_mixing",
    r"""
    WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS draw, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0 * CAST(sum(size) AS DOUBLE) AS most,
      CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END :: DOUBLE AS weight FROM d GROUP BY source),
    f AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(most) OVER b, 0)) / sum(weight) OVER o AS share FROM s
      WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    l AS (SELECT arg_min(share, most / weight) AS level FROM f WHERE most >= share * weight),
    r AS (SELECT source, source_size, least(most, coalesce(level * weight, most)) AS target FROM f, l),
    j AS (SELECT d.doc_id, d.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
      CAST(('0x' || substr(md5('mix:' || draw), 1, 13)) AS BIGINT) / 4503599627370496.0 :: DOUBLE AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from emberlog.llm.mixing import plan_mix

    planned = plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def _secrets_sql() -> str:
    """Positions from the lengths of what lies between and within matches, for each rule."""
    from emberlog.llm.secrets import BASE_KINDS, RULES

    parts = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {rank} AS rank, '{kind}' AS kind, gap_sum + found_sum - len(found) AS b, gap_sum + found_sum AS e, measured FROM (
          SELECT doc_id, found, measured, sum(len(gap)) OVER w AS gap_sum, sum(len(found)) OVER w AS found_sum FROM (
            SELECT doc_id, unnest(f) AS found, unnest(g) AS measured, unnest(regexp_split_to_array(text, '{quoted}')[:len(f)]) AS gap, generate_subscripts(f, 1) AS k
            FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS f, regexp_extract_all(text, '{quoted}', {group}) AS g FROM d) WHERE len(f) > 0)
          WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE len(measured) >= {least}""")
    counts = ", ".join(f"count(*) FILTER (rank = {k}) AS n_{RULES[k][0]}" for k in range(BASE_KINDS))
    names = ", ".join(f"coalesce(n_{RULES[k][0]}, 0) AS n_{RULES[k][0]}" for k in range(BASE_KINDS))
    one = "kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, rank"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({" UNION ALL ".join(parts)}),
    a AS (SELECT doc_id, {counts}, string_agg({one}) FILTER (rank < {BASE_KINDS}) AS base, string_agg({one}) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id
    """


@query("op7_secret_scans", _secrets_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.secrets import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents")))


def _licenses_sql() -> str:
    """Phrases by the words' places; templates by the overlap of sets for every line, or every window of a longer one."""
    from emberlog.llm.licenses import CONTAINMENT, LOWER, NAMED, PHRASES, TEMPLATES, UPPER, WORD, needed, words_of

    def listed(words) -> str:
        return f"[{', '.join(repr(w) for w in words)}] :: VARCHAR[]"

    lists = "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in p.split()) + "]" for p, _ in PHRASES) + "]"
    labels = "[" + ", ".join(f"'{x}'" for _, x in PHRASES) + "]"
    rows = []
    for label, text in TEMPLATES:
        words = sorted(set(words_of(text)))
        must, never = NAMED.get(label, ((), ()))
        width = -(-len(words_of(text)) * 10 // round(CONTAINMENT * 10))
        rows.append(f"('{label}', {listed(words)}, {needed(len(words), CONTAINMENT)}, {width}, {listed(must)}, {listed(never)})")
    return rf"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM d),
    p AS (SELECT unnest({lists}) AS phrase, unnest({labels}) AS label),
    h AS (SELECT doc_id, label, unnest(list_filter(range(1, len(words) + 1), lambda i: words[i:i + len(phrase) - 1] = phrase)) - 1 AS place FROM w, p),
    b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM h GROUP BY doc_id),
    t(label, words, least, width, must, never) AS (VALUES {", ".join(rows)}),
    l AS (SELECT doc_id, regexp_extract_all(line, '{WORD}') AS raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
    c AS (SELECT doc_id, t.*, raw FROM l, t WHERE len(raw) >= t.least AND len(list_intersect(list_distinct(raw), t.words)) >= t.least),
    k AS (SELECT doc_id, label, words, least, must, never, list_distinct(raw[i:i + width - 1]) AS own FROM (SELECT *, unnest(range(1, greatest(len(raw) - width, 0) + 2)) AS i FROM c)),
    m AS (SELECT doc_id, label, len(list_intersect(own, words)) AS overlap, len(words) AS n FROM k WHERE len(list_intersect(own, words)) >= least AND list_has_all(own, must) AND NOT list_has_any(own, never)),
    g AS (SELECT doc_id, list(DISTINCT label) AS more, max(CAST(overlap AS DOUBLE) / n) AS share FROM m GROUP BY doc_id)
    SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
      array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
      CASE WHEN n_base > 0 THEN 1.0 :: DOUBLE ELSE coalesce(share, 0.0 :: DOUBLE) END AS score
    FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id
    """


@query("op6_license_scans", _licenses_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


@query(
    "op2_line_dedup",
    """
    WITH l AS (SELECT doc_id, md5(text) AS th, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY p) AS stop FROM l),
    q AS (SELECT *, stop - len(line) - 1 AS start FROM s),
    f AS (SELECT doc_id, min(p) OVER w AS first, max(p) OVER w AS last, list(line) OVER w AS run, max(stop) OVER w - min(start) OVER w AS chars FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 99 FOLLOWING)),
    b AS (SELECT doc_id, min(p) OVER w AS first, max(p) OVER w AS last, list(line) OVER w AS run, max(stop) OVER w - min(start) OVER w AS chars FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 99 PRECEDING AND CURRENT ROW)),
    w AS (SELECT DISTINCT doc_id, first, last, run FROM (FROM f UNION ALL FROM b) WHERE chars >= 100 UNION SELECT doc_id, p, p, [line] FROM l WHERE len(line) >= 30),
    r AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS k FROM w) WHERE k > 1),
    g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS p FROM r),
    k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_deleted,
      coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (g.p IS NULL), '') AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from emberlog.llm.linededup import LINE_CHARS, dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")), line_chars=LINE_CHARS)
    deleted = F.aggregate(F.coalesce("_runs", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return done.select("doc_id", "n_lines", deleted.alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op4_minhash_near_dedup",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
    n AS (SELECT doc_id, len(g) AS n FROM s),
    e AS (SELECT doc_id, unnest(g) AS x FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
    m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
    SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.doc_id = n.doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.neardup import link_documents

    return link_documents(table(spark, sf_dir, "documents"), k=2)


@query(
    "op5_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
    r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
    m AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
    SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN m ON m.vec_id = v.vec_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.covertree import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_histogram_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.nnls import pack_by_histogram

    return pack_by_histogram(table(spark, sf_dir, "documents"))


#: The CRC-32 of the decimal `doc_id` or `conv_id`, byte by byte over the table t of the 256 remainders.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384 :: BIGINT) ELSE c >> 1 END, i)) AS t"


def _crc(digits: str) -> str:
    """The checksum of a string of ASCII characters, in SQL, where t is the table above."""
    return f"xor(list_reduce(list_transform(string_split({digits}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8), 4294967295 :: BIGINT), 4294967295 :: BIGINT)"


def _trie_sql() -> str:
    """Prefixes as lists of turns; a subtree by comparing lists."""
    return rf"""
    WITH k AS ({_CRC_TABLE}),
    o AS (SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
    s AS (SELECT c, list(x ORDER BY p) AS own FROM o GROUP BY c),
    h AS (SELECT s.c, own, coalesce(b.base, []) AS base, {_crc("CAST(s.c AS VARCHAR)")} % 4 AS h FROM k, s LEFT JOIN (SELECT c, own AS base FROM s) b ON b.c = s.c - s.c % 20),
    r AS (SELECT c, list_concat(base[:h], own[h + 1:]) AS turns FROM h),
    m AS (SELECT c, turns[:d] AS path, d, d = len(turns) AS last FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
    n AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends,
      CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM m GROUP BY path, d),
    q AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.path[:n.depth] = n.path) AS n_children
      FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1])
    SELECT a.conv_id, a.depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
      count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens, sha256(any_value(a.ends)) AS ends_sha256
    FROM q a JOIN q b ON b.depth >= a.depth AND b.path[:a.depth] = a.path GROUP BY a.path, a.depth, a.conv_id
    """


@query("op12_prefix_trie", _trie_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.trie import graft, numbered_turns, prefix_trie

    turns, members = graft(numbered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, members).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _manifest_sql(fan: int = 8) -> str:
    """Levels by recursion; a row's siblings by the place of its ancestor in each level."""

    def leaf(text: str) -> str:
        fields = [f"CAST({f} AS VARCHAR)" for f in ("doc_id", "source", "lang", "n_chars")] + [text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"

    def levels(name: str, start: str) -> str:
        return f"""{name} AS ({start}
          UNION ALL SELECT level + 1, g, i // {fan}, (any_value(n) + {fan - 1}) // {fan}, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, g, i // {fan})"""

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    power = f"CAST({fan} ** level AS BIGINT)"
    sides = f"string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < a.i // {power.replace('level', 's.level')}) AS lo, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > a.i // {power.replace('level', 's.level')}) AS hi"
    return f"""
    WITH RECURSIVE k AS ({_CRC_TABLE}),
    d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS shown FROM documents, k),
    a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
    {levels("t", "SELECT 0 AS level, g, i, n, leaf AS h FROM a")},
    b AS (SELECT g, h AS leaf, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
    {levels("u", "SELECT 0 AS level, '' AS g, i, n, leaf AS h FROM b")},
    top AS (SELECT h AS root FROM u WHERE n = 1),
    f AS (SELECT a.g, a.i, s.level, {sides} FROM a JOIN t s ON s.g = a.g AND s.n > 1 AND s.i // {fan} = a.i // ({fan} * {power.replace("level", "s.level")}) GROUP BY a.g, a.i, s.level),
    e AS (SELECT a.g, s.level, {sides} FROM b a JOIN u s ON s.n > 1 AND s.i // {fan} = a.i // ({fan} * {power.replace("level", "s.level")}) GROUP BY a.g, a.i, s.level),
    p AS (SELECT g, i, list({{'lo': coalesce(lo, ''), 'hi': coalesce(hi, '')}} ORDER BY level) AS steps FROM f GROUP BY g, i),
    o AS (SELECT g, list({{'lo': coalesce(lo, ''), 'hi': coalesce(hi, '')}} ORDER BY level) AS steps FROM e GROUP BY g),
    w AS (SELECT a.doc_id, a.leaf, a.shown, b.leaf AS subroot, root, list_concat(coalesce(p.steps, []), coalesce(o.steps, [])) AS steps
      FROM a JOIN b ON b.g = a.g CROSS JOIN top LEFT JOIN p ON p.g = a.g AND p.i = a.i LEFT JOIN o ON o.g = a.g),
    v AS (SELECT *, list_reduce(list_transform(steps, lambda x: x.lo || '|' || x.hi), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), shown) AS folded_root FROM w)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.lo || x.hi), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM v
    """


@query("op13_merkle_manifest", _manifest_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlog.llm.merkle import lowered, manifest, verified

    found = verified(manifest(table(spark, sf_dir, "documents"), lowered()))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
