"""DuckDB statements that give the same rows as the queries, by other means."""

from __future__ import annotations

from wordmend.functions.patterns import BUILTIN_ENGLISH, COMMON_TYPOS
from wordmend.functions.patterns import EMAIL as _EMAIL
from wordmend.functions.patterns import URL as _URL
from wordmend.queries.tables import EXTENSIONS

_PART = r"[\p{L}''][\p{Ll}\p{Lt}\p{Lm}\p{Lo}'']*"
_MARKDOWN = r"[\p{L}''\-]+"
_LETTERS = r"\p{L}+"
_TYPED, _MEANT = ("".join(side) for side in zip(*COMMON_TYPOS, strict=True))

# levenshtein() of DuckDB counts bytes. Letters of two bytes are written as one byte that
# does not occur in words, which makes byte and character distance equal.
_WIDE = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
_NARROW = "0123456789!#$%&()*+,./:;<=>?@[]^"


def _distance(a: str, b: str) -> str:
    return (
        f"levenshtein(translate({a}, '{_WIDE}', '{_NARROW}'), "
        f"translate({b}, '{_WIDE}', '{_NARROW}'))"
    )


def _lines(name: str, table: str, keys: str, text: str, where: str = "true") -> str:
    """CTEs that end in ``name(keys, line, line_start, t)``."""
    return rf"""
{name}_raw AS (SELECT {keys}, {text} AS body FROM {table} WHERE {where}),
{name}_split AS (
  SELECT {keys}, unnest(string_split(body, chr(10))) AS t,
         generate_subscripts(string_split(body, chr(10)), 1) AS line FROM {name}_raw),
{name} AS (
  SELECT *, sum(strlen(t) + 1) OVER (PARTITION BY {keys} ORDER BY line
                                     ROWS UNBOUNDED PRECEDING) - strlen(t) - 1 AS line_start
  FROM {name}_split)"""


def _pieces(name: str, source: str, keys: str, pattern: str, text: str = "t") -> str:
    """CTEs that end in ``name``: matches of a pattern with byte and character offsets."""
    order = f"PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING"
    return rf"""
{name}_cut AS (
  SELECT *, unnest(regexp_extract_all({text}, '{pattern}')) AS tok,
         unnest(string_split_regex({text}, '{pattern}')) AS gap,
         generate_subscripts(string_split_regex({text}, '{pattern}'), 1) AS i
  FROM {source}),
{name}_placed AS (
  SELECT *, sum(strlen(gap) + coalesce(strlen(tok), 0)) OVER ({order})
            - coalesce(strlen(tok), 0) AS byte_pos,
         sum(length(gap) + coalesce(length(tok), 0)) OVER ({order})
            - coalesce(length(tok), 0) AS char_pos
  FROM {name}_cut),
{name} AS (SELECT * FROM {name}_placed WHERE tok IS NOT NULL)"""


def _tokens(name: str, table: str, keys: str, text: str = "text", where: str = "true") -> str:
    """CTEs that end in ``name``: plain-text words with positions and their line."""
    return rf"""{_lines(f"{name}_lines", table, keys, text, where)},{
        _pieces(f"{name}_pieces", f"{name}_lines", f"{keys}, line", _PART)},
{name} AS (
  SELECT {keys}, line::INT AS line, (byte_pos + 1)::INT AS "column",
         (line_start + byte_pos)::INT AS "start",
         (line_start + byte_pos + strlen(tok))::INT AS "end",
         CASE WHEN i > 1 AND gap = '' THEN lower(substr(tok, 1, 1)) || substr(tok, 2)
              ELSE tok END AS word,
         tok, t, char_pos
  FROM {name}_pieces
  WHERE strlen(tok) > 1 AND replace(tok, '''', '') <> '')"""


_BUILTIN = "(VALUES " + ", ".join(f"('{w}')" for w in BUILTIN_ENGLISH.split()) + ") v(word)"
_DICTIONARY = (
    _tokens("bench", "benchmark", "item_id")
    + f""",
dictionary AS (SELECT lower(word) AS word FROM bench UNION SELECT word FROM {_BUILTIN})"""
)
_PERSONAL = (
    _tokens("mine", "conversations", "conv_id, turn", where="role = 'user'")
    + ",\npersonal AS (SELECT DISTINCT lower(word) AS word FROM mine)"
)
_DOCS = _tokens("docs", "documents", "doc_id")


def _ignored(word: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return (
        f"(strlen({word}) <= 1 OR regexp_full_match({word}, '\\p{{N}}+')"
        f" OR regexp_matches({word}, '(^|{edge})[A-Z0-9_]{{2,}}($|{edge})')"
        f" OR regexp_matches({word}, '{_URL}')"
        f" OR regexp_matches({word}, '(^|{edge})[a-fA-F0-9]{{32,}}($|{edge})')"
        f" OR regexp_matches({word}, '{_EMAIL}'))"
    )


def _unknown(name: str, tokens: str, *lists: str) -> str:
    known = " ".join(
        f"AND NOT EXISTS (SELECT 1 FROM {k} k WHERE k.word = lower(t.word))" for k in lists
    )
    return f"\n{name} AS (SELECT * FROM {tokens} t WHERE NOT {_ignored('t.word')} {known})"


_CHECKED = f"{_DICTIONARY},{_DOCS},{_unknown('bad', 'docs', 'dictionary')}"
_ASKED = f"{_CHECKED},\nasked AS (SELECT DISTINCT lower(word) AS word FROM bad)"

_VARIANTS = f"""
  list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))
  || list_transform(range(1, length(word)), lambda i: substr(word, 1, i - 1)
       || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2))
  || list_transform(
       list_filter(range(1, length(word) + 1), lambda i: contains('{_TYPED}', substr(word, i, 1))),
       lambda i: substr(word, 1, i - 1) || translate(substr(word, i, 1), '{_TYPED}', '{_MEANT}')
         || substr(word, i + 1))"""


def _suggestions(asked: str = "asked", short: str = "WHERE r <= 100") -> str:
    """CTEs that end in ``ranked(word, candidate, position)``."""
    near = _distance("a.word", "d.word")
    return f"""
alike AS (
  SELECT a.word, d.word AS candidate, {near} AS distance
  FROM {asked} a JOIN dictionary d ON left(a.word, 2) = left(d.word, 2)
  WHERE length(a.word) >= 2 AND length(d.word) >= 2
    AND abs(length(a.word) - length(d.word)) <= 3),
made AS (
  SELECT word, unnest(v) AS candidate, generate_subscripts(v, 1) - 1 AS position
  FROM (SELECT word, {_VARIANTS} AS v FROM {asked})),
sizes AS (SELECT unnest([1, 2, 3]) AS for_size),
short_list AS (
  SELECT for_size, word FROM (
    SELECT s.for_size, d.word,
           row_number() OVER (PARTITION BY s.for_size ORDER BY encode(d.word)) AS r
    FROM dictionary d JOIN sizes s ON abs(length(d.word) - s.for_size) <= 1)
  {short}),
candidates AS (
  SELECT word, candidate, 1 AS stage, distance AS rank FROM alike
  WHERE distance <= 2 AND length(word) >= 3 AND left(word, 3) = left(candidate, 3)
  UNION ALL
  SELECT m.word, m.candidate, 2, m.position FROM made m JOIN dictionary d ON d.word = m.candidate
  UNION ALL
  SELECT word, candidate, 3, distance FROM alike WHERE distance <= 3
  UNION ALL
  SELECT a.word, d.word, 4, {near}
  FROM {asked} a JOIN short_list d ON length(a.word) = d.for_size WHERE {near} <= 2),
best AS (
  SELECT word, candidate, min(stage * 1000000 + rank) AS score FROM candidates GROUP BY ALL),
ranked AS (
  SELECT word, candidate,
         row_number() OVER (PARTITION BY word ORDER BY score, encode(candidate)) AS position
  FROM best)"""


def _suggested(k: int, short: str = "WHERE r <= 100") -> str:
    return (
        _suggestions(short=short)
        + f""",
suggested AS (
  SELECT a.word, coalesce(string_agg(r.candidate, ',' ORDER BY r.position), '') AS suggestions,
         coalesce(list(r.candidate ORDER BY r.position) FILTER (r.candidate IS NOT NULL), []) AS list
  FROM asked a LEFT JOIN ranked r ON r.word = a.word AND r.position <= {k}
  GROUP BY a.word)"""
    )


_CONTEXT = """(CASE WHEN char_pos > 20 THEN '...' ELSE '' END
    || substr(t, greatest(char_pos - 20, 0)::BIGINT + 1,
              (least(char_pos, 20) + length(tok) + 20)::BIGINT)
    || CASE WHEN char_pos + length(tok) + 20 < length(t) THEN '...' ELSE '' END)"""


def _rewritten(source: str, keys: str, text: str, edits: str) -> str:
    """CTE ``done``: documents cut at the edits (``start``, ``end``, ``new``) and put together."""
    on = " AND ".join(f"s.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    order = f'PARTITION BY {keys} ORDER BY "start"'
    cut = f"""
kept AS (
  SELECT *, coalesce(lag("end") OVER ({order}), 0) AS before FROM {edits} WHERE new IS NOT NULL),
parts AS (
  SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, e."start", e."end",
         decode(array_slice(encode(s.{text}), e.before + 1, e."start")) || e.new AS part
  FROM {source} s JOIN kept e ON {on}),
joined AS (
  SELECT {keys}, string_agg(part, '' ORDER BY "start") AS front, max("end") AS last, count(*) AS n
  FROM parts GROUP BY {keys}),
done AS (
  SELECT {", ".join("s." + k.strip() for k in keys.split(","))},
         CASE WHEN e.n IS NULL THEN s.{text}
              ELSE e.front || decode(array_slice(encode(s.{text}), e.last + 1, strlen(s.{text}))) END
           AS text,
         coalesce(e.n, 0)::INT AS fixed_count
  FROM {source} s LEFT JOIN joined e ON {on})"""
    return cut


def _list(where: str) -> str:
    return (
        "(SELECT unnest(string_split_regex(text, '\\s+')) AS w "
        f"FROM conversations WHERE {where})"
    )


# Every line as a string literal of source code.
_DECORATED_TEXT = """array_to_string(
  list_transform(string_split(text, chr(10)), lambda x: 's = "' || x || '";'), chr(10))"""


def _decorated(line: str, comment: str, literal: str) -> str:
    """Words of the comment and of the literals of every line ``d``, made from line ``t``. An escape
    pair separates words."""
    pattern = literal.replace("'", "''")
    return rf"""
WITH made AS (
  SELECT doc_id, {line} AS d FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)),
literals AS (SELECT doc_id, unnest(regexp_extract_all(d, '{pattern}')) AS part FROM made),
parts AS (
  SELECT doc_id, {comment} AS part FROM made
  UNION ALL
  SELECT doc_id, regexp_replace(part, '\\.', '  ', 'g') FROM literals),
words AS (SELECT doc_id, unnest(regexp_extract_all(part, '{_LETTERS}')) AS word FROM parts)
SELECT doc_id, word, count(*) AS n FROM words WHERE strlen(word) > 1 GROUP BY ALL"""


def _without_regions(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{_URL}', ' ', 'g'), '{_EMAIL}', ' ', 'g')"


def _extension_case() -> str:
    return (
        "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + f"][(doc_id % {len(EXTENSIONS)})::INT + 1]"
    )


# Words of documents by file type. The texts hold no "//", back-slash, apostrophe, back-tick,
# bracket, "<" or ";", so only "#" and double quotes matter in code, and nothing in Markdown.
_MIXED_KEYS = "doc_id, ext"


def _mixed(text: str) -> str:
    ext = f"lower({_extension_case()})"
    plain = _tokens("plain", "typed", _MIXED_KEYS, where="ext IN ('txt', 'log')")
    markdown = _lines("md_lines", "typed", _MIXED_KEYS, "text", "ext = 'md'") + "," + _pieces(
        "md", "md_lines", "doc_id, line", _MARKDOWN
    )
    code = _lines("code_lines", "typed", _MIXED_KEYS, "text", "ext NOT IN ('txt', 'log', 'md')")
    literals = _pieces("closed", "code_lines", "doc_id, line", '"[^"]*"')
    open_literals = _pieces("literal", "code_lines", "doc_id, line", '"[^"]*("|$)')
    return rf"""
typed AS (SELECT doc_id, {text} AS text, {ext} AS ext FROM documents),{plain},{markdown},{code},{
    literals},{open_literals},
fragments AS (
  SELECT doc_id, line, 0 AS fragment, line_start + strlen(string_split(t, '#')[1]) + 1 AS base,
         substr(t, instr(t, '#') + 1) AS f
  FROM code_lines
  WHERE ext = 'py' AND contains(t, '#')
    AND (length(string_split(t, '#')[1]) - length(replace(string_split(t, '#')[1], '"', ''))) % 2 = 0
  UNION ALL
  SELECT doc_id, line, i, line_start + byte_pos, tok FROM closed WHERE ext = 'py'
  UNION ALL
  SELECT doc_id, line, i, line_start + byte_pos, tok FROM literal WHERE ext <> 'py'),{
    _pieces("code", "fragments", "doc_id, line, fragment", _LETTERS, "f")},
mixed AS (
  SELECT doc_id, word, line, "start" FROM plain
  UNION ALL
  SELECT doc_id, tok, line, line_start + byte_pos FROM md WHERE regexp_matches(tok, '\p{{L}}')
  UNION ALL
  SELECT doc_id, tok, line, base + byte_pos FROM code WHERE strlen(tok) > 1)"""


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    out["files_read"] = "SELECT item_id, text FROM benchmark"
    ext = f"lower({_extension_case()})"
    out["file_types"] = f"""
SELECT CASE WHEN e = 'md' THEN 'markdown' WHEN e IN ('txt', 'log') THEN 'plain_text'
            ELSE 'source_code' END AS file_type,
       CASE e WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'js' THEN 'javascript'
              WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'cpp' THEN 'cpp'
              WHEN 'tsx' THEN 'tsx' END AS source_lang,
       count(*) AS files
FROM (SELECT {ext} AS e FROM documents) GROUP BY ALL"""
    out["personal_list"] = f"""
SELECT DISTINCT lower(w) AS word FROM {_list('true')} WHERE w <> '' AND NOT starts_with(w, '#')"""
    out["raw_word_list"] = f"""
SELECT word, count(*) AS n FROM (
  SELECT lower(w) AS word FROM {_list('true')}
  UNION ALL SELECT rtrim('# ' || lower(w)) FROM {_list("role = 'user'")})
WHERE strlen(word) > 1 GROUP BY word"""
    out["builtin_coverage"] = f"""
WITH {_DOCS}
SELECT lower(word) AS word, count(*) AS n FROM docs
WHERE lower(word) IN (SELECT word FROM {_BUILTIN}) GROUP BY ALL"""

    out["document_lines"] = f"""
WITH {_DOCS}
SELECT doc_id, line::INT AS line, line_start::INT AS line_start, strlen(t)::INT AS bytes
FROM docs_lines"""
    out["token_counts"] = f"WITH {_DOCS} SELECT doc_id, count(*) AS tokens FROM docs GROUP BY ALL"
    out["token_positions"] = (
        f'WITH {_DOCS} SELECT doc_id, word, line, "column", "start", "end" FROM docs'
    )
    out["token_contexts"] = (
        f'WITH {_DOCS} SELECT doc_id, "start", word, {_CONTEXT} AS context FROM docs'
    )
    out["compound_parts"] = f"WITH {_DOCS} SELECT word, count(*) AS n FROM docs GROUP BY ALL"

    # A quote inside a comment is looked at as a literal again. C literals may be open.
    c_literal, python_literal = r'"[^"]*("|$)', r"""'[^']*'|"[^"]*\""""
    out["code_comment_words"] = _decorated("'x = 1; // ' || t", "substr(d, 11)", c_literal)
    out["code_string_words"] = _decorated(r"""'s = "\t' || t || '";'""", "''", c_literal)
    out["python_comment_words"] = _decorated("'y = 2 # ' || t", "substr(d, 8)", python_literal)
    before = "string_split(d, '#')[1]"
    quotes = f"""(length({before}) - length(translate({before}, '"''', '')))"""
    comment = (
        f"CASE WHEN contains(d, '#') AND {quotes} % 2 = 0 "
        "THEN substr(d, instr(d, '#') + 1) ELSE '' END"
    )
    out["python_string_words"] = _decorated(r"'s = ''' || t || '\n'''", comment, python_literal)
    every = f"SELECT doc_id, unnest(regexp_extract_all(text, '{_LETTERS}')) AS word FROM documents"
    out["block_comment_words"] = out["docstring_words"] = (
        f"SELECT doc_id, word, count(*) AS n FROM ({every}) WHERE strlen(word) > 1 GROUP BY ALL"
    )
    coded = _lines("coded", "documents", "doc_id", _DECORATED_TEXT)
    out["nested_comment_words"] = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    text || ' ' || text || ' outer last end', '{_LETTERS}')) AS word FROM documents)
SELECT doc_id, word, count(*) AS n FROM words WHERE strlen(word) > 1 GROUP BY ALL"""
    out["code_positions"] = f"""
WITH {coded},{_pieces("literal", "coded", "doc_id, line", c_literal)},
inside AS (
  SELECT doc_id, line, i AS number, line_start + byte_pos AS base, line_start, tok AS f FROM literal),{
    _pieces("found", "inside", "doc_id, line, number", _LETTERS, "f")}
SELECT doc_id, tok AS word, line::INT AS line, (base - line_start + byte_pos + 1)::INT AS "column",
       (base + byte_pos)::INT AS "start", (base + byte_pos + strlen(tok))::INT AS "end",
       CASE WHEN strlen(f) <= 4000 THEN regexp_extract(f, '^"([^"]*)"', 1) END AS context
FROM found WHERE strlen(tok) > 1"""
    out["markdown_contexts"] = rf"""
WITH {_lines("md_lines", "documents", "doc_id", "text")},{
    _pieces("md", "md_lines", "doc_id, line", _MARKDOWN)}
SELECT doc_id, (line_start + byte_pos)::INT AS "start", tok AS word,
  CASE WHEN char_pos > 20 THEN '...' ELSE '' END
    || substr(t, greatest(char_pos - 20, 0)::BIGINT + 1,
              (least(char_pos, 20) + length(tok) + 20)::BIGINT)
    || CASE WHEN char_pos <= 20 AND char_pos + length(tok) + 20 < length(t) THEN '...' ELSE '' END
    AS context
FROM md WHERE regexp_matches(tok, '\p{{L}}')"""
    out["markdown_words"] = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_MARKDOWN}')) AS word FROM documents
  UNION ALL
  SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: 'shown')) FROM documents)
SELECT doc_id, word, count(*) AS n FROM words WHERE regexp_matches(word, '\p{{L}}') GROUP BY ALL"""
    # The first half is listed twice: its copies have the same content.
    out["watched_files"] = f"""
WITH {_tokens('bench', 'benchmark', 'item_id')},builtin AS (SELECT word FROM {_BUILTIN})
SELECT item_id, word, count(*) * CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM bench
WHERE lower(word) NOT IN (SELECT word FROM builtin) AND NOT {_ignored('word')}
GROUP BY item_id, word"""
    out["large_file_words"] = f"""
WITH files AS (
  SELECT doc_id % 4 AS part, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS text
  FROM documents GROUP BY ALL),{_tokens('docs', 'files', 'part')}
SELECT part, word, count(*) AS n, min("start")::BIGINT AS first_start, max(line)::BIGINT AS last_line,
       sum("column")::BIGINT AS "columns"
FROM docs GROUP BY ALL"""
    out["markdown_blocks"] = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
         (generate_subscripts(string_split(text, chr(10)), 1) - 1) % 6 AS form FROM documents),
shown AS (
  SELECT doc_id, 'Line ' || x || CASE form WHEN 0 THEN ' Deep ' || x || ' more ' || x
    WHEN 1 THEN ' lazy ' || x WHEN 2 THEN ' after ' || x WHEN 4 THEN ' after ' || x ELSE '' END AS t
  FROM lines),
words AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_MARKDOWN}')) AS word FROM shown)
SELECT doc_id, word, count(*) AS n FROM words WHERE regexp_matches(word, '\p{{L}}') GROUP BY ALL"""
    out["mixed_file_words"] = f"""
WITH {_mixed("text")}
SELECT doc_id, word, count(*) AS n, min("start")::INT AS first_start, max(line)::INT AS last_line
FROM mixed GROUP BY doc_id, word"""
    out["email_masked_words"] = f"""
WITH {_tokens('docs', 'documents', 'doc_id', _without_regions("text"))}
SELECT doc_id, word, count(*) AS n FROM docs GROUP BY ALL"""
    page = "url || ' ' || html"
    out["url_masked_words"] = f"""
WITH {_tokens('docs', 'pages', 'page_id', _without_regions(page))}
SELECT page_id, count(*) AS tokens, sum(strlen(word))::BIGINT AS bytes FROM docs GROUP BY ALL"""

    out["ignored_words"] = rf"""
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '{_MARKDOWN}')) AS word FROM documents)
WHERE regexp_matches(word, '\p{{L}}') AND {_ignored('word')} GROUP BY ALL"""
    vocabulary = "SELECT word, lower(word) AS w, count(*) AS n FROM bad GROUP BY ALL"
    out["unknown_vocabulary"] = f"WITH {_CHECKED} {vocabulary}"
    out["unknown_with_personal"] = (
        f"WITH {_DICTIONARY},{_PERSONAL},{_DOCS},"
        f"{_unknown('bad', 'docs', 'dictionary', 'personal')} {vocabulary}"
    )
    out["top_misspellings"] = f"""
WITH {_CHECKED}
SELECT w AS word, count(*) AS n FROM (SELECT lower(word) AS w FROM bad) GROUP BY w
ORDER BY n DESC, encode(w) LIMIT 100"""

    out["prefix_candidates"] = f"""
WITH {_ASKED},
heads AS (
  SELECT left(word, 3) AS head, count(*) AS candidates, arg_min(word, encode(word)) AS first,
         arg_max(word, encode(word)) AS last
  FROM dictionary WHERE length(word) >= 3 GROUP BY ALL)
SELECT a.word, h.candidates, h.first, h.last FROM asked a JOIN heads h ON left(a.word, 3) = h.head
WHERE length(a.word) >= 3"""
    for name, size, far in (("near_candidates", 3, 2), ("far_candidates", 2, 3)):
        distance = _distance("a.word", "d.word")
        out[name] = f"""
WITH {_ASKED}
SELECT * FROM (
  SELECT a.word, d.word AS candidate, {distance}::INT AS distance
  FROM asked a JOIN dictionary d ON left(a.word, {size}) = left(d.word, {size})
  WHERE length(a.word) >= {size} AND length(d.word) >= {size}
    AND abs(length(a.word) - length(d.word)) <= {far})
WHERE distance <= {far}"""
    out["typo_variants"] = f"""
WITH {_ASKED} SELECT word, array_to_string({_VARIANTS}, ',') AS variants FROM asked"""
    out["variant_candidates"] = f"""
WITH {_ASKED},
made AS (
  SELECT word, unnest(v) AS candidate, generate_subscripts(v, 1) - 1 AS position
  FROM (SELECT word, {_VARIANTS} AS v FROM asked))
SELECT word, candidate, min(position)::INT AS position FROM made
WHERE candidate IN (SELECT word FROM dictionary) GROUP BY ALL"""
    out["short_candidates"] = f"""
WITH {_ASKED},{_suggestions()} SELECT for_size, word FROM short_list"""
    out["suggestions_top5"] = f"WITH {_ASKED},{_suggested(5)} SELECT word, suggestions FROM suggested"
    out["suggestion_top1"] = f"""
WITH {_ASKED},{_suggested(1)} SELECT word, list[1] AS suggestion FROM suggested"""

    out["check_report"] = f"""
WITH {_ASKED},{_suggested(5)}
SELECT doc_id, b.word, line, "column", "start", "end", {_CONTEXT} AS context, suggestions
FROM bad b JOIN suggested s ON s.word = lower(b.word)"""
    out["check_mixed_files"] = f"""
WITH {_DICTIONARY},{_PERSONAL},{_mixed(_without_regions("text"))},{
    _unknown("bad", "mixed", "dictionary", "personal")},
asked AS (SELECT DISTINCT lower(word) AS word FROM bad),{_suggested(5)}
SELECT doc_id, b.word, suggestions, count(*) AS n
FROM bad b JOIN suggested s ON s.word = lower(b.word) GROUP BY ALL"""
    out["misspellings_by_document"] = f"""
WITH {_CHECKED}
SELECT d.doc_id, count(b.doc_id) AS error_count
FROM documents d LEFT JOIN bad b ON b.doc_id = d.doc_id GROUP BY d.doc_id"""
    turns = _tokens("turns", "conversations", "conv_id, turn")
    out["misspellings_by_turn"] = f"""
WITH {_DICTIONARY},{turns},{_unknown('bad', 'turns', 'dictionary')}
SELECT d.conv_id, d.turn, count(b.conv_id) AS error_count
FROM conversations d LEFT JOIN bad b ON b.conv_id = d.conv_id AND b.turn = d.turn
GROUP BY d.conv_id, d.turn"""
    out["check_summary"] = f"""
WITH {_CHECKED}
SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS total_errors,
       count(*) = 0 AS passed FROM bad"""
    report_lines = f"""
SELECT doc_id, line, "column", b.word, {_CONTEXT} AS context,
       array_to_string(list[1:5], ', ') AS suggestions
FROM bad b JOIN suggested s ON s.word = lower(b.word)"""
    # All short words of the dictionary are candidates, not the first 100.
    out["report_lines"] = f"""
WITH {_ASKED},{_suggested(9, short="")}{report_lines}"""
    out["report_json"] = f"""
WITH {_ASKED},{_suggested(5)},
rows AS (
  SELECT doc_id, "start", {{'file': 'd' || doc_id, 'line': line, 'column': "column", 'word': b.word,
         'suggestions': list, 'context': {_CONTEXT}}} AS e
  FROM bad b JOIN suggested s ON s.word = lower(b.word)),
lists AS (SELECT doc_id, list(e ORDER BY "start") AS errors, count(*)::INT AS n FROM rows GROUP BY doc_id)
SELECT 1 AS files_checked, coalesce(n, 0)::INT AS total_errors,
       coalesce(to_json(errors)::VARCHAR, '[]') AS errors
FROM documents d LEFT JOIN lists l ON l.doc_id = d.doc_id"""

    out["review_options"] = f"""
WITH {_DICTIONARY},{turns},{_unknown('bad', 'turns', 'dictionary')},
asked AS (SELECT DISTINCT lower(word) AS word FROM bad),{_suggested(12)}
SELECT conv_id, turn, "start", b.word, array_to_string(
         list_transform(list[1:9], lambda s, i: '[' || i || '] ' || s), ' ') AS options
FROM bad b JOIN suggested s ON s.word = lower(b.word)"""

    first = 'edits AS (SELECT {keys}, "start", "end", list[1] AS new FROM bad b JOIN suggested s ON s.word = lower(b.word))'
    out["autofix_text"] = f"""
WITH {_ASKED},{_suggested(1)},
{first.format(keys='doc_id')},{_rewritten('documents', 'doc_id', 'text', 'edits')},
open AS (SELECT doc_id, count(*) AS n FROM edits WHERE new IS NULL GROUP BY doc_id)
SELECT d.doc_id, d.text, d.fixed_count, coalesce(o.n, 0)::INT AS unfixed_count
FROM done d LEFT JOIN open o ON o.doc_id = d.doc_id"""
    out["changed_texts"] = f"""
WITH {_DICTIONARY},{_PERSONAL},{turns},{_unknown('bad', 'turns', 'dictionary', 'personal')},
asked AS (SELECT DISTINCT lower(word) AS word FROM bad),{_suggested(1)},
{first.format(keys='conv_id, turn')},{_rewritten('conversations', 'conv_id, turn', 'text', 'edits')}
SELECT conv_id, turn, text, fixed_count FROM done WHERE fixed_count > 0"""
    out["fix_summary"] = f"""
WITH {_ASKED},{_suggested(1)},
{first.format(keys='doc_id')}
SELECT (SELECT count(*) FROM documents) AS documents, count(new) AS total_fixed FROM edits"""
    out["reviewed_fix"] = f"""
WITH {_ASKED},{_suggested(5)},
edits AS (
  SELECT doc_id, "start", "end",
         CASE WHEN "start" % 4 >= 2 AND line % 7 >= 1 THEN list[line % 7] END AS new
  FROM bad b JOIN suggested s ON s.word = lower(b.word)),{_rewritten('documents', 'doc_id', 'text', 'edits')}
SELECT doc_id, text, fixed_count FROM done"""
    out["added_personal_words"] = f"""
WITH {_CHECKED},{_PERSONAL}
SELECT DISTINCT lower(word) AS word FROM bad
WHERE "start" % 4 = 1 AND lower(word) NOT IN (SELECT word FROM personal)"""

    language = _tokens("docs", "documents", "doc_id, lang")
    out["dictionary_build"] = f"""
WITH {language} SELECT DISTINCT lower(word) AS word FROM docs WHERE lang = 'en'"""
    sizes = "SELECT lang AS language, count(DISTINCT lower(word)) AS word_count FROM docs GROUP BY lang"
    out["dictionary_listing"] = f"""
WITH {language} SELECT *, true AS has_bytes, true AS has_path FROM ({sizes})"""
    out["dictionary_info"] = f"WITH {language} SELECT * FROM ({sizes}) WHERE language = 'fr'"
    out["dictionary_update"] = f"""
WITH {language},{_tokens('bench', 'benchmark', 'item_id')}
SELECT language, CASE WHEN language = 'de' THEN (SELECT count(DISTINCT lower(word)) FROM bench)
                      ELSE word_count END AS word_count FROM ({sizes})"""
    out["dictionary_word_counts"] = f"WITH {language} {sizes}"

    # What was written is read again: the same rows.
    out["report_json_file"] = out["report_json"]
    out["report_lines_file"] = f"""
WITH {_ASKED},{_suggested(9)}{report_lines}"""
    out["report_lines_order"] = f"WITH {_CHECKED} SELECT DISTINCT doc_id, true AS in_order FROM bad"
    out["corrected_texts_file"] = out["changed_texts"]
    out["personal_list_file"] = f"""
WITH {_CHECKED},{_PERSONAL}
SELECT word FROM personal
UNION SELECT lower(word) FROM bad WHERE "start" % 4 = 1"""
    bench = _tokens("bench", "benchmark", "item_id")
    out["dictionary_installed"] = f"WITH {bench} SELECT DISTINCT lower(word) AS word FROM bench"
    out["dictionary_from_table"] = f"""
WITH {bench} SELECT lower(word) AS word, count(*) AS n FROM bench GROUP BY ALL"""
    out["ignored_by_pattern"] = rf"""
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS word FROM documents)
WHERE {_ignored('word')} OR regexp_matches(word, 'ing$') GROUP BY ALL"""
    return out
