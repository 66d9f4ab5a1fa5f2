"""One query per operator or group of operators, over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmend.functions.edits import variants
from wordmend.functions.patterns import DEFAULT_IGNORE, DEFAULT_REGIONS
from wordmend.operators.suggest import (
    CLOSE,
    WIDE,
    near_words,
    prefix_matches,
    short_word_candidates,
    suggest,
    variant_matches,
)
from wordmend.operators.tokens import lines, tokens
from wordmend.operators.words import is_ignored, known_words, unknown_words, valid_patterns
from wordmend.plans.check import (
    RANGE,
    check,
    find,
    misspellings_per_document,
    placed_tokens,
    summarize,
)
from wordmend.plans.fix import (
    ADD,
    REPLACE,
    SKIP,
    accepted_words,
    apply_decisions,
    fix,
    new_personal_words,
    summarize_fixes,
    with_decisions,
)
from wordmend.plans.report import (
    FLAT_FORMAT,
    append_personal_words,
    changed_documents,
    flat_report_in_ranges,
    json_report,
    review_list,
    write_corrected,
    write_flat_report,
    write_json_report,
)
from wordmend.plans.watch import check_new_files, checked_files
from wordmend.queries.tables import (
    DOC,
    TURN,
    conversations,
    decorate,
    dictionary,
    documents,
    personal,
    positions_of,
    read,
    unknown,
    with_path,
    words_of,
)
from wordmend.runtime import shared_folder, stage
from wordmend.sources.dictionaries import (
    describe_dictionary,
    dictionary_catalog,
    install_dictionary,
    load_dictionary,
    load_word_table,
    update_dictionaries,
    word_counts,
    words_in_order,
    write_dictionaries,
)
from wordmend.sources.documents import (
    file_type,
    read_documents,
    read_lines,
    source_lang,
    spread,
)
from wordmend.sources.wordlists import (
    builtin_words,
    listed_words,
    personal_words,
    read_personal_words,
)

Query = Callable[[SparkSession, str], DataFrame]
POSITION = ["line", "column", "start", "end"]
# Queries whose time is in the CPU deal documents out if there are fewer parts for each core.
ROUNDS = 3
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _as_text(suggestions: str = "suggestions") -> Column:
    return F.array_join(suggestions, ",").alias("suggestions")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _per_word(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


# --- sources ---------------------------------------------------------------------------


@query
def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as documents; a missing path is skipped."""
    folder = _folder(spark, "files")
    read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy(
        "item_id"
    ).text(folder)
    files = read_documents(spark, [folder, folder + "-missing"])
    return files.select(
        F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"),
        F.regexp_replace("text", r"\n\z", "").alias("text"),
    )


@query
def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files checked as they arrive: those of the first half, then the others and copies of the first."""
    folder, out = _folder(spark, "arriving"), _folder(spark, "watched")
    rows = read(spark, sf_dir, "benchmark").select(F.col("text").alias("value"), "item_id")
    late = F.col("item_id") % 2 == 1
    for part, some in (("first", rows.where(~late)), ("second", rows)):
        some.write.partitionBy("item_id").text(f"{folder}/{part}")
        check_new_files(spark, f"{folder}/*/*", out, builtin_words(spark)).awaitTermination()
    found = checked_files(spark, out)
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint")
    return found.groupBy(item.alias("item_id"), "word").agg(F.count("*").alias("n"))


@query
def large_file_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a few large files, written in pieces and read in blocks: words with their places in the files."""
    folder = _folder(spark, "large")
    parts = read(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("value"), (F.col("doc_id") % 4).alias("part")
    )
    # A piece is a range of a file, of about what a task reads of the table.
    pieces = max(4, parts.rdd.getNumPartitions())
    sorted_parts = parts.repartitionByRange(pieces, "part", "doc_id").sortWithinPartitions("part", "doc_id")
    sorted_parts.drop("doc_id").write.partitionBy("part").text(folder)
    found = positions_of(read_lines(spark, folder, pieces=True), ["path"], by_line=True)
    return found.groupBy(
        F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part"), "word"
    ).agg(
        F.count("*").alias("n"),
        F.min("start").alias("first_start"),
        F.max("line").alias("last_line"),
        F.sum("column").alias("columns"),
    )


@query
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = with_path(read(spark, sf_dir, "documents").select("doc_id"))
    return paths.groupBy(
        file_type(F.col("path")).alias("file_type"),
        source_lang(F.col("path")).alias("source_lang"),
    ).agg(F.count("*").alias("files"))


def _list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw list: a line per word with blanks around it, users' words as comments too."""
    words = conversations(spark, sf_dir).select("role", F.explode(F.split("text", r"\s+")).alias("w"))
    return words.select(F.concat(F.lit("  "), F.col("w"), F.lit(" ")).alias("value")).unionByName(
        words.where(F.col("role") == "user").select(F.concat(F.lit("# "), F.col("w")).alias("value"))
    )


@query
def personal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_words(_list_lines(spark, sf_dir))


@query
def raw_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_words(_list_lines(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))


@query
def builtin_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each built-in word occurs."""
    words = words_of(documents(spark, sf_dir), DOC).select(F.lower("word").alias("word"))
    return (
        words.join(F.broadcast(builtin_words(spark)), "word")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


# --- tokenizers ------------------------------------------------------------------------


@query
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(documents(spark, sf_dir), DOC, "text").select(
        "doc_id", "line", "line_start", F.octet_length("text").alias("bytes")
    )


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(documents(spark, sf_dir), DOC)
    return words.groupBy("doc_id").agg(F.count("*").alias("tokens"))


@query
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions_of(documents(spark, sf_dir), DOC).select("doc_id", "word", *POSITION)


@query
def token_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(documents(spark, sf_dir), DOC).select("doc_id", "start", "word", "context")


@query
def compound_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after compounds were split, with their number of occurrences."""
    words = words_of(documents(spark, sf_dir), DOC)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _decorated_words(
    spark: SparkSession, sf_dir: str, before: str, after: str, ext: str, **options: object
) -> DataFrame:
    made = documents(spark, sf_dir).select(
        "doc_id", decorate(before, after).alias("text"), F.lit(f"x.{ext}").alias("path")
    )
    return words_of(made, DOC, path="path", **options)


@query
def code_comment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_word(_decorated_words(spark, sf_dir, "x = 1; // ", "", "rs"))


@query
def code_string_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_word(_decorated_words(spark, sf_dir, 's = "\\t', '";', "cpp"))


@query
def python_comment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_word(_decorated_words(spark, sf_dir, "y = 2 # ", "", "py"))


@query
def python_string_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_word(_decorated_words(spark, sf_dir, "s = '", "\\n'", "pyw"))


@query
def block_comment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block comments over several lines, an option that is off by default."""
    made = documents(spark, sf_dir).select(
        "doc_id",
        F.concat(
            F.lit("int code;\n/* "), F.col("text"), F.lit("\n */ more(code);")
        ).alias("text"),
        F.lit("x.java").alias("path"),
    )
    return _per_word(words_of(made, DOC, path="path", block_comments=True))


@query
def nested_comment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments in comments and raw strings over several lines, by the same option."""
    made = documents(spark, sf_dir, ROUNDS).select(
        "doc_id",
        F.concat(
            F.lit("fn code() {}\n/* outer /* "),
            F.col("text"),
            F.lit('\n */ last */ code();\nlet s = r#####"'),
            F.col("text"),
            F.lit('\n"# "#####; code(); // end'),
        ).alias("text"),
        F.lit("x.rs").alias("path"),
    )
    return _per_word(words_of(made, DOC, path="path", block_comments=True))


@query
def docstring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docstrings over several lines, by the same option."""
    made = documents(spark, sf_dir, ROUNDS).select(
        "doc_id",
        F.concat(
            F.lit('def code():\n    """'), F.col("text"), F.lit('\n    """\n    more(code)')
        ).alias("text"),
        F.lit("x.py").alias("path"),
    )
    return _per_word(words_of(made, DOC, path="path", block_comments=True))


@query
def code_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of string literals with their places, and their contexts in literals of one piece."""
    made = documents(spark, sf_dir, ROUNDS).select(
        "doc_id", decorate('s = "', '";').alias("text"), F.lit("x.go").alias("path")
    )
    found = tokens(made, DOC, path="path")
    whole = ~F.startswith("context", F.lit("...")) & ~F.endswith("context", F.lit("..."))
    return found.select("doc_id", "word", *POSITION, F.when(whole, F.col("context")).alias("context"))


@query
def markdown_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(spark, sf_dir).withColumn("path", F.lit("x.md"))
    return tokens(made, DOC, path="path").select("doc_id", "start", "word", "context")


@query
def markdown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs with inline code and a link, each followed by a fenced copy."""
    paragraph = F.transform(
        F.split("text", "\n", -1),
        lambda x: F.concat(
            x,
            F.lit(" `some code` [shown](http://hidden.example/page 'title')\n\n```text\n"),
            x,
            F.lit("\n```\n"),
        ),
    )
    made = documents(spark, sf_dir, ROUNDS).select(
        "doc_id", F.array_join(paragraph, "\n").alias("text"), F.lit("x.md").alias("path")
    )
    return _per_word(words_of(made, DOC, path="path"))


# Lines of documents in nested lists, quotes, code and HTML; only what is not hidden is text.
BLOCK_FORMS = (
    ("- Line ", "\n\n      hidden ", "\n\n  - Deep ", "\n\n    more ", "\n"),
    ("> Line ", "\nlazy ", "\n>\n>     hidden ", "\n"),
    ("1. Line ", "\n   ```\n   hidden ", "\n   ```\n\n   after ", "\n"),
    ("- > Line ", "\n  >\n  > ~~~\n  > hidden ", "\n  > ~~~\n"),
    ("> - Line ", "\n>\n>       hidden ", "\n>\n>   after ", "\n"),
    ("* <div>\n  hidden ", "\n\n  Line ", "\n"),
)


@query
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines stand in lists and quotes, with code and HTML inside these."""

    def form(x: Column, i: Column) -> Column:
        made = F.lit(None).cast("string")
        for n, parts in enumerate(BLOCK_FORMS):
            spelled = [F.lit(parts[0]), *(p for part in parts[1:] for p in (x, F.lit(part)))]
            made = F.when(i % len(BLOCK_FORMS) == n, F.concat(*spelled)).otherwise(made)
        return made

    made = documents(spark, sf_dir, ROUNDS).select(
        "doc_id",
        F.array_join(F.transform(F.split("text", "\n", -1), form), "\n").alias("text"),
        F.lit("x.md").alias("path"),
    )
    return _per_word(words_of(made, DOC, path="path"))


@query
def mixed_file_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all file types in one pass, each by its own rules."""
    made = with_path(documents(spark, sf_dir))
    return positions_of(made, DOC, path="path").groupBy("doc_id", "word").agg(
        F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("line").alias("last_line")
    )


@query
def email_masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without URLs and e-mail addresses."""
    words = words_of(documents(spark, sf_dir), DOC, skip_regions=DEFAULT_REGIONS)
    return _per_word(words)


@query
def url_masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over raw pages, which are full of URLs."""
    pages = spread(
        read(spark, sf_dir, "pages").select(
            "page_id", F.concat("url", F.lit(" "), "html").alias("text")
        )
    )
    words = words_of(pages, ["page_id"], skip_regions=DEFAULT_REGIONS)
    return words.groupBy("page_id").agg(
        F.count("*").alias("tokens"), F.sum(F.octet_length("word")).alias("bytes")
    )


# --- filters and look-ups --------------------------------------------------------------


@query
def ignored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(spark, sf_dir).withColumn("path", F.lit("x.md"))
    counts = words_of(made, DOC, path="path").groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(is_ignored(F.col("word")))


@query
def ignored_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers too, a pattern of the user's own, and one that is no regular expression."""
    words = documents(spark, sf_dir).select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")
    )
    rules = valid_patterns(spark, [*DEFAULT_IGNORE, "[", "ing$"])
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(is_ignored(F.col("word"), rules))


@query
def unknown_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_words(dictionary(spark, sf_dir))
    return unknown_words(words_of(documents(spark, sf_dir), DOC), known)


@query
def unknown_with_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_words(dictionary(spark, sf_dir), personal(spark, sf_dir))
    return unknown_words(words_of(documents(spark, sf_dir), DOC), known)


@query
def top_misspellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent misspelled words."""
    known = known_words(dictionary(spark, sf_dir))
    words = unknown_words(words_of(documents(spark, sf_dir), DOC), known)
    return (
        words.groupBy(F.col("w").alias("word"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(100)
    )


# --- candidates and suggestions --------------------------------------------------------


@query
def prefix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each unknown word: how many dictionary words begin alike, the first and the last."""
    words = dictionary(spark, sf_dir)
    return prefix_matches(unknown(spark, sf_dir, words), words, 3)


@query
def near_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary(spark, sf_dir)
    return near_words(unknown(spark, sf_dir, words), words, CLOSE)


@query
def far_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary(spark, sf_dir)
    return near_words(unknown(spark, sf_dir, words), words, WIDE)


@query
def typo_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = unknown(spark, sf_dir, dictionary(spark, sf_dir))
    return words.select("word", F.array_join(variants(F.col("word")), ",").alias("variants"))


@query
def variant_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary(spark, sf_dir)
    return variant_matches(unknown(spark, sf_dir, words), words)


@query
def short_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_word_candidates(dictionary(spark, sf_dir))


@query
def suggestions_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary(spark, sf_dir)
    return suggest(unknown(spark, sf_dir, words), words).select("word", _as_text())


@query
def suggestion_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary(spark, sf_dir)
    best = suggest(unknown(spark, sf_dir, words), words, 1)
    return best.select("word", F.get("suggestions", F.lit(0)).alias("suggestion"))


# --- check -----------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), DOC, dictionary(spark, sf_dir))


@query
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check(documents(spark, sf_dir), DOC, dictionary(spark, sf_dir))
    return found.select("doc_id", "word", *POSITION, "context", _as_text())


@query
def check_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All file types, a personal list, and URLs and e-mail addresses left out."""
    found = check(
        with_path(documents(spark, sf_dir, ROUNDS)),
        DOC,
        dictionary(spark, sf_dir),
        personal(spark, sf_dir),
        path="path",
        skip_regions=DEFAULT_REGIONS,
    )
    return found.groupBy("doc_id", "word", _as_text()).agg(F.count("*").alias("n"))


@query
def misspellings_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misspellings_per_document(documents(spark, sf_dir), _found(spark, sf_dir), DOC)


@query
def misspellings_by_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a key of two columns."""
    turns = conversations(spark, sf_dir)
    found = find(turns, TURN, dictionary(spark, sf_dir))
    return misspellings_per_document(turns, found, TURN)


@query
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(_found(spark, sf_dir), documents(spark, sf_dir))


def _flat(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    docs, words = documents(spark, sf_dir), dictionary(spark, sf_dir)
    found = placed_tokens(docs, DOC, words, max_suggestions=9, ranges=True, **options)[1]
    return flat_report_in_ranges(found, DOC, RANGE)


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, words = documents(spark, sf_dir), dictionary(spark, sf_dir)
    found = placed_tokens(docs, DOC, words)[1]
    return json_report(docs, found, DOC, F.concat(F.lit("d"), F.col("doc_id")))


@query
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir, all_short=True)


@query
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _json(spark, sf_dir)
    return report.select("files_checked", "total_errors", F.to_json("errors").alias("errors"))


@query
def review_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir)
    found = check(turns, TURN, dictionary(spark, sf_dir), max_suggestions=12)
    listed = review_list(found, TURN)
    return listed.select(*TURN, "start", "word", F.array_join("options", " ").alias("options"))


@query
def report_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it was written and read again."""
    report = _json(spark, sf_dir)
    folder = _folder(spark, "report-json")
    write_json_report(report, folder)
    again = spark.read.schema(report.schema).json(folder)
    return again.select("files_checked", "total_errors", F.to_json("errors").alias("errors"))


def _flat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _flat(spark, sf_dir)
    folder = _folder(spark, "report-lines")
    write_flat_report(report, folder)
    return spark.read.options(**FLAT_FORMAT).schema(report.schema).csv(folder)


def _place_in_files() -> Column:
    """Where a line stands in the files: they are read in parts, and not in their order."""
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return F.struct(
        number.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )


@query
def report_lines_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_file(spark, sf_dir).fillna("", ["suggestions"])


@query
def report_lines_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the lines of a document stand in reading order in the file?"""
    lines = _flat_file(spark, sf_dir).select("doc_id", "line", "column", _place_in_files().alias("_place"))
    place = F.array_sort(F.collect_list(F.struct("_place", F.struct("line", "column").alias("at"))))
    places = lines.groupBy("doc_id").agg(place.getField("at").alias("at"))
    return places.select("doc_id", (F.col("at") == F.array_sort("at")).alias("in_order"))


# --- fix -------------------------------------------------------------------------------


@query
def autofix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix(documents(spark, sf_dir, ROUNDS).drop("lang"), DOC, dictionary(spark, sf_dir))


@query
def changed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).select(*TURN, "text")
    fixed = fix(turns, TURN, dictionary(spark, sf_dir), personal(spark, sf_dir))
    return changed_documents(fixed).select(*TURN, "text", "fixed_count")


@query
def corrected_texts_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected documents as they were written and read again."""
    turns = conversations(spark, sf_dir).select(*TURN, "text")
    folder = _folder(spark, "corrected")
    write_corrected(fix(turns, TURN, dictionary(spark, sf_dir), personal(spark, sf_dir)), folder)
    return spark.read.parquet(folder).select(*TURN, "text", "fixed_count")


@query
def personal_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A personal list after a review has added words to it."""
    folder = _folder(spark, "personal")
    append_personal_words(personal(spark, sf_dir), folder)
    known = read_personal_words(spark, folder)
    found = _reviewed(spark, sf_dir)
    decided = with_decisions(found, _decisions(found), DOC)
    append_personal_words(new_personal_words(accepted_words(decided), known), folder)
    return read_personal_words(spark, folder)


@query
def fix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_fixes(fix(documents(spark, sf_dir, ROUNDS), DOC, dictionary(spark, sf_dir)))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspellings as a review is given them: found once, as the decisions are made from them."""
    found = find(documents(spark, sf_dir, ROUNDS), DOC, dictionary(spark, sf_dir))
    return stage(found.select(*DOC, "word", "line", "start", "end"), "reviewed")


def _decisions(found: DataFrame) -> DataFrame:
    """A decision for every misspelling, made from its place."""
    turn = F.col("start") % 4
    return found.select(
        *DOC,
        "start",
        "end",
        F.when(turn == 0, SKIP).when(turn == 1, ADD).otherwise(REPLACE).alias("action"),
        (F.col("line") % 7).alias("choice"),
    )


@query
def reviewed_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).drop("lang")
    docs, found = placed_tokens(docs, DOC, dictionary(spark, sf_dir), context=False)
    return apply_decisions(docs, found, _decisions(found), DOC)[0]


@query
def added_personal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reviewed(spark, sf_dir)
    decided = with_decisions(found, _decisions(found), DOC)
    return new_personal_words(accepted_words(decided), personal(spark, sf_dir))


# --- dictionaries ----------------------------------------------------------------------


def _language_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return words_of(docs, ["lang"]).select(
        F.col("lang").alias("language"), F.lower("word").alias("word")
    )


def _installed(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark, "dictionaries")
    write_dictionaries(_language_words(spark, sf_dir), folder)
    return folder


@query
def dictionary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _installed(spark, sf_dir)
    return words_in_order(load_dictionary(spark, folder, "en"))


@query
def dictionary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = dictionary_catalog(spark, _installed(spark, sf_dir))
    return catalog.select(
        "language",
        "word_count",
        (F.col("size_bytes") > 0).alias("has_bytes"),
        F.endswith("path", F.concat(F.lit("language="), F.col("language"))).alias("has_path"),
    )


@query
def dictionary_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = describe_dictionary(spark, _installed(spark, sf_dir), "fr")
    return described.select("language", "word_count")


@query
def dictionary_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuild an installed language from a word list; the others stay as they are."""
    folder = _installed(spark, sf_dir)
    source = _folder(spark, "wordlist")
    words_of(read(spark, sf_dir, "benchmark"), ["item_id"]).select(
        F.col("word").alias("value")
    ).write.text(source)
    update_dictionaries(spark, {"de": source, "xx": source}, folder)
    return dictionary_catalog(spark, folder).select("language", "word_count")


@query
def dictionary_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language installed from a word-list file."""
    source, folder = _folder(spark, "wordlist"), _folder(spark, "dictionaries")
    words_of(read(spark, sf_dir, "benchmark"), ["item_id"]).select(
        F.col("word").alias("value")
    ).write.text(source)
    install_dictionary(spark, source, folder, "new")
    return load_dictionary(spark, folder, "new")


@query
def dictionary_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any table of words as a dictionary, in whatever case they are written."""
    folder = _folder(spark, "words")
    words_of(read(spark, sf_dir, "benchmark"), ["item_id"]).select("word").write.parquet(folder)
    return load_word_table(spark, folder).groupBy("word").agg(F.count("*").alias("n"))


@query
def dictionary_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(_language_words(spark, sf_dir))
