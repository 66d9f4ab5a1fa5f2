"""The operators applied to the given tables: one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmend.llm import (
    chat,
    fingerprints,
    forest,
    language,
    licenses,
    mixing,
    neardup,
    neighbours,
    packing,
    repair,
    repeats,
    scoring,
    trie,
)
from wordmend.runtime import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document a mix with the target weights takes."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(rows).drop("text", "source")


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, then read back from the formatted text and its mask."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", odd), (-7, 1, "assistant", odd)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_conversations(rows.unionByName(extra))
    line = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.withColumns(
            {
                "_turns": chat.read_turns(F.col("formatted")),
                "_loss": F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_mask")), ""),
            }
        )
        .select(
            "conv_id",
            F.size("_turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
            F.char_length("_loss").cast("bigint").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )


ORACLES["op1_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
    SELECT *,
        replace(replace(replace(replace(replace(text, '\', '\\'),
            '<turn>', '<\turn>'), '<says/>', '<\says/>'), '<next/>', '<\next/>'), '</turn>', '<\/turn>')
            AS safe_text,
        replace(replace(replace(replace(replace(role, '\', '\\'),
            '<turn>', '<\turn>'), '<says/>', '<\says/>'), '<next/>', '<\next/>'), '</turn>', '<\/turn>')
            AS safe_role,
        role IS DISTINCT FROM lag(role) OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
        AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
        FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(safe_text) + CASE WHEN opens
        THEN length(safe_role) + length('<turn><says/></turn>') ELSE length('<next/>') END) AS BIGINT)
        AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out quarter."""
    held_out = language.fold(F.col("doc_id"), 4) == 2
    rows = _read(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text", "lang")
    model = language.fit(rows.where(~F.col("held_out")).select("text", "lang"))
    return language.predict(rows.select("doc_id", "held_out", "text"), model, keep_text=False)


@query
def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).drop("node")


@query
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand in an earlier one."""
    return repeats.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one, among all."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(rows, F.col("vec_id") % 50 == 0)


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = licenses.scan(_read(spark, sf_dir, "documents"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.transform("places", lambda p: p["label"])
    own = F.transform("notices", lambda b: b["label"])
    best = F.array_max(F.transform("notices", lambda b: b["containment"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


@query
def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of an edit of it, and how alike they are."""
    return fingerprints.compare_edits(_read(spark, sf_dir, "documents"))


@query
def op7_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is, learned from those outside the held-out seventh."""
    held_out = language.fold(F.col("doc_id"), 7) == 2
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scoring.score(rows, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def _damaged(rows: DataFrame) -> DataFrame:
    """The conversations with faults by the checksum of ``conv_id:turn``; a dropped row stays as one
    that only names its conversation."""
    words = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *words)) % 20
    text = F.coalesce("text", F.lit(" "))
    role = F.coalesce("role", F.lit(" "))
    return rows.withColumn("_fault", fault).select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("_fault") == 1, "")
        .when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        (F.col("_fault") == 0).alias("dropped"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )


@query
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, then repaired with the fewest edits."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.repair(_damaged(rows), absent="dropped")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    hashed = F.sha2(F.array_join(lines, "\n"), 256)
    return done.withColumn("repaired_sha256", hashed).drop("turns")


def _crc32_sql(name: str) -> str:
    """The checksum of an ASCII string, bit by bit."""
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(1, length({name}) + 1),
            lambda i: CAST(ascii(substr({name}, i, 1)) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
            lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""


# A shortest path over four states (what the output ends with: nothing, s, u, a). A value is the cost
# in eight digits, then the audit, so that the least value has the least audit.
def _add(value: str, cost: str, edit: str) -> str:
    return f"printf('%08d', CAST(substr({value}, 1, 8) AS INT) + {cost}) || substr({value}, 9) || '{edit}'"


_STEP_SQL = f"""{{
    'n': {_add("q.n", "3", "D")},
    's': least({_add("q.s", "3", "D")},
        CASE WHEN x.initial = 's' AND NOT x.lost THEN {_add("q.n", "x.cut", "K")} ELSE '50000000' END),
    'u': least({_add("q.u", "3", "D")}, CASE WHEN x.lost THEN '50000000' WHEN x.initial = 'u'
        THEN least({_add("q.n", "x.cut", "K")}, {_add("q.s", "x.cut", "K")}, {_add("q.a", "x.cut", "K")})
        ELSE least({_add("q.n", "x.cut + 2", "R")}, {_add("q.s", "x.cut + 2", "R")},
            {_add("q.a", "x.cut + 2", "R")}) END),
    'a': least({_add("q.a", "3", "D")}, CASE WHEN x.lost THEN '50000000' WHEN x.initial = 'a'
        THEN {_add("q.u", "x.cut", "K")} ELSE {_add("q.u", "x.cut + 2", "R")} END)
}}"""


def _insert_sql(q: str) -> str:
    user = f"least({q}.u, {_add(q + '.n', '2', 'I')}, {_add(q + '.s', '2', 'I')}, {_add(q + '.a', '2', 'I')})"
    assistant = f"least({q}.a, {_add('(' + user + ')', '2', 'I')})"
    return f"{{'n': {q}.n, 's': {q}.s, 'u': {user}, 'a': {assistant}}}"


ORACLES["op11_structure_repair"] = rf"""
WITH keyed AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), checked AS (
    SELECT *, {_crc32_sql("name")} % 20 AS fault
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
            ELSE coalesce(text, ' ') END AS text,
        unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
    FROM checked WHERE fault <> 0
), placed AS (
    SELECT *, substr(role, 1, 1) AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place
    FROM damaged
), judged AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS wrong,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS bad
    FROM placed
), listed AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (wrong = 'blank') AS blank, count(*) FILTER (wrong = 'duplicate') AS duplicate,
        count(*) FILTER (wrong = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal,
        list({{'initial': initial, 'lost': wrong IN ('blank', 'duplicate'),
            'cut': CASE WHEN wrong = 'truncated' THEN 1 ELSE 0 END}} ORDER BY place) AS steps,
        list({{'role': role, 'text': text}} ORDER BY place) AS turns
    FROM judged GROUP BY conv_id
), every AS (
    SELECT DISTINCT conv_id FROM conversations
), solved AS (
    SELECT e.conv_id, l.* EXCLUDE (conv_id, steps), list_reduce(list_prepend(
            {{'q': {_insert_sql("{'n': '00000000', 's': '50000000', 'u': '50000000', 'a': '50000000'}")},
              'x': {{'initial': '', 'lost': false, 'cut': 0}}}},
            list_transform(coalesce(steps, []), lambda x: {{'q': {{'n': '', 's': '', 'u': '', 'a': ''}}, 'x': x}})),
        lambda acc, e: {{'q': list_transform(list_transform([{{'q': acc.q, 'x': e.x}}],
            lambda p: list_transform([p.q], lambda q: list_transform([p.x], lambda x: {_STEP_SQL})[1])[1]),
            lambda q: {_insert_sql("q")})[1], 'x': e.x}}).q AS ends
    FROM every e LEFT JOIN listed l ON e.conv_id IS NOT DISTINCT FROM l.conv_id
), best AS (
    SELECT *, least(ends.n, ends.a) AS value, substr(least(ends.n, ends.a), 9) AS audit FROM solved
), written AS (
    SELECT *, length(replace(audit, 'D', '')) % 2 AS odd,
        list_filter(list_transform(range(1, length(audit) + 1), lambda i: {{
            'edit': substr(audit, i, 1), 'nth': length(replace(substr(audit, 1, i), 'D', '')),
            'row': length(replace(substr(audit, 1, i), 'I', ''))}}), lambda e: e.edit <> 'D') AS edits
    FROM best
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(substr(value, 1, 8) AS BIGINT) AS cost, audit,
    sha256(array_to_string(list_transform(edits, lambda e:
        CASE WHEN e.edit = 'K' THEN turns[e.row].role WHEN (e.nth - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN e.edit = 'I' THEN '' ELSE turns[e.row].text END), chr(10))) AS repaired_sha256
FROM written
"""


@query
def op13_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return forest.near_vectors(_read(spark, sf_dir, "embeddings"))


ORACLES["op13_vector_neardup"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
), counted AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a
"""


def _forked(steps: DataFrame, keys: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation ``c - c % 20`` instead of its own."""
    own = keys.select(
        "key",
        (F.col("key") - F.col("key") % 20).alias("_base"),
        (F.crc32(F.col("key").cast("string")) % 4).alias("_h"),
    )
    heads = steps.where("place < 3").select(F.col("key").alias("_base"), "place", "digest", "words")
    taken = own.where("_h > 0").join(heads, "_base").where("place < _h")
    sizes = taken.groupBy("key").agg(F.count("*").alias("_taken"))
    moves = own.join(sizes, "key", "left").select("key", "_h", F.coalesce("_taken", F.lit(0)).alias("_k"))
    kept = steps.join(moves, "key").where("place >= _h")
    return taken.select("key", "place", "digest", "words").unionByName(
        kept.select("key", (F.col("place") - F.col("_h") + F.col("_k")).alias("place"), "digest", "words")
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with turns of an earlier one."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    steps = stage(trie.ordered(turns), "conversation-turns")
    keys = stage(steps.select("key").distinct(), "conversation-keys")
    return trie.trie(stage(_forked(steps, keys), "conversation-forks"), keys)


ORACLES["op12_prefix_trie"] = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(text, '') AS text, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':'
        || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({{'g': digest, 'w': len(regexp_extract_all(text, '[^ 	-]+'))}}
        ORDER BY turn NULLS FIRST, digest) AS path,
        {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
    FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.path[1:o.h], []), o.path[o.h + 1:]) AS path
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), steps AS (
    SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt
), nodes AS (
    SELECT list_transform(path[1:depth], lambda t: t.g) AS prefix, depth, min(conv_id) AS conv_id,
        count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(path[depth].w), 0) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
            FILTER (len(path) = depth), '')) AS ends_sha256
    FROM steps GROUP BY ALL
), families AS (
    SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix)
        AS n_children
    FROM nodes n
)
SELECT n.conv_id, n.depth, (SELECT p.conv_id FROM nodes p
        WHERE p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]) AS parent_conv_id,
    any_value(n.n_convs) AS n_convs, any_value(n.n_children) AS n_children,
    count(*) FILTER (d.n_children = 0) AS n_leaves, CAST(sum(d.saved) AS BIGINT) AS saved_tokens,
    any_value(n.ends_sha256) AS ends_sha256
FROM families n JOIN families d ON d.depth >= n.depth AND d.prefix[1:n.depth] = n.prefix
GROUP BY n.conv_id, n.depth, n.prefix
"""
