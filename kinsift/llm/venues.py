"""Mapping freely typed values to the entries of a reference list (problem 4), in SQL only.

Distinct values and the list's names are brought to one form: lower-case ASCII words without numbering, years, volumes, decorations,
repeated short names and filler words, the kind of series first. A value that is a short name after that is mapped by equality. The
others go through a partition-based pigeonhole join: a reference form is cut into k + 1 segments, so within k edits at least one
segment stays whole at nearly its place; values are cut at just those places, equality-joined on (length, segment, substring), and
verified with levenshtein. Forms with words that are cut short ("Rev. Ambient Reg.") go through the same principle over words: the
beginnings of the list's own words are the abbreviations, one word must stay whole as far as it goes, and edits are summed over words.
What an anti-join leaves over is reported with venue_id -1.

Null and blank values are no cases, nor are values equal to a list entry. A value as near to two entries means neither. Repeated
rows come out once per row. An empty list gives -1 everywhere, an empty table no rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .common import Workspace, table

#: Edits allowed between the forms of a value and an entry.
MAX_EDITS = 2
#: Usual abbreviations of the kinds of series.
KIND_SHORT = {"review": "rev", "workshop": "wkshp", "transactions": "trans", "annual conference": "conf", "symposium": "symp", "letters": "lett", "journal": "j"}
#: Least letters of a word that is cut short.
LEAST_LETTERS = 3
_KINDS = "|".join(KIND_SHORT)
_KINDS_ANY = "|".join([*KIND_SHORT, *KIND_SHORT.values()])
#: Rules that bring a value to its form, in order; their patterns mean the same in Java and RE2.
RULES = [
    (r"[_\x{00A0}\t\r\n]+", " "),
    (r"<[^<>]*>|&[a-z]+;", " "),
    (r"\[[^\]]*\]", " "),
    (r"['’]\d\d\b", " "),
    (r"\bvol(ume|\.)? *\d+", " "),
    (r"^ *in *: *", ""),
    (r"\b(1st|2nd|3rd|\d+th)\b", " "),
    (r"^ *(proceedings|proc\.?)( of)?( the)?( |$)", " "),
    (r"\bproceedings\b", " "),
    (r"^ *(int\.|international) ", " "),
    (r"\b(19|20)\d\d\b", " "),
    (r"^ *([a-z]+)(19|20)\d\d *$", "$1"),
]
#: After the rules: a short name before a colon, or in brackets beside several words, repeats the name; a name in brackets after a short name counts.
_AFTER = [
    (r"^ *[a-z]{3,6} *: *([a-z].* .*)$", "$1"),
    (r"^ *[a-z]{3,6} *\((.* .*)\) *$", "$1"),
    (rf"^(.*)[(,] *({_KINDS_ANY})\.?( *(on|of|in|for))? *\)? *$", "$2 $1"),
    (r"^(.* .*[^ ]) *\( *[a-z]{3,6} *\) *$", "$1"),
    (r"[^a-z ,()]+", " "),
    (r"[,()]+", " "),
    (r"\b(the|on|of|in|for|and)\b", " "),
    (r" +", " "),
]


def _form(column: str, engine: str) -> str:
    """SQL of the form of a column; engine: spark or duckdb."""
    sql = f"lower({column})"
    for pattern, to in RULES + _AFTER:
        pattern = pattern.replace("'", "''")
        if engine == "spark":
            sql = f"regexp_replace({sql}, r'{pattern}', '{to}')" if "''" not in pattern else f'regexp_replace({sql}, r"{pattern.replace(chr(39) * 2, chr(39))}", \'{to}\')'
        else:
            sql = f"regexp_replace({sql}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    sql = f"trim({sql})"
    # a kind at the end, as in "Portable Genome Annotation Review", goes first
    if engine == "spark":
        return f"regexp_replace({sql}, r'^(.* .*) ({_KINDS})$', '$2 $1')"
    return f"regexp_replace({sql}, '^(.* .*) ({_KINDS})$', '\\2 \\1')"


def _short_kinds(sql: str, engine: str) -> str:
    for full, short in KIND_SHORT.items():
        sql = f"regexp_replace({sql}, r'\\b{full}\\b', '{short}')" if engine == "spark" else f"regexp_replace({sql}, '\\b{full}\\b', '{short}', 'g')"
    return sql


def _entry_forms(engine: str, entries: str) -> str:
    return f"""
  SELECT form, min(venue_id) AS venue_id FROM (
    SELECT venue_id, form FROM {entries}
    UNION ALL SELECT venue_id, {_short_kinds("form", engine)} AS form FROM {entries}
  ) AS f WHERE form <> '' GROUP BY form HAVING min(venue_id) = max(venue_id)"""


def _word_cost(t: str, e: str) -> str:
    """Edits between a typed word and a word of the list, which may be cut short to LEAST_LETTERS or more, with one slip if more."""
    beginnings = ", ".join(f"levenshtein({t}, left({e}, length({t}){d}))" for d in ("", " - 1", " + 1"))
    return f"CASE WHEN length({t}) < {LEAST_LETTERS} THEN levenshtein({t}, {e}) WHEN left({e}, length({t})) = {t} THEN 0 WHEN length({t}) > {LEAST_LETTERS} AND least({beginnings}) <= 1 THEN 1 ELSE levenshtein({t}, {e}) END"


def _cases(engine: str) -> str:
    bare = "regexp_replace(r.venue, r'[ \\s\\x{00A0}]+', '')" if engine == "spark" else "regexp_replace(r.venue, '[\\s\\x{00A0}]+', '', 'g')"
    return f"""
  SELECT r.row_id, r.venue FROM results r
  LEFT JOIN (SELECT venue_name AS known FROM venue_list UNION SELECT short_name FROM venue_list) AS k ON r.venue = k.known
  WHERE k.known IS NULL AND r.row_id IS NOT NULL AND r.venue IS NOT NULL AND length({bare}) > 0"""


_BY_SHORT = """
  SELECT f.form, min(v.venue_id) AS venue_id FROM forms f JOIN venue_list v ON f.form = lower(v.short_name)
  GROUP BY f.form HAVING min(v.venue_id) = max(v.venue_id)"""
_NAMED = """
  WITH best AS (SELECT form, min(edits) AS edits FROM near GROUP BY form),
  by_name AS (
    SELECT n.form, min(n.venue_id) AS venue_id FROM near n JOIN best b ON n.form = b.form AND n.edits = b.edits
    GROUP BY n.form HAVING min(n.venue_id) = max(n.venue_id)
  ),
  mapped AS (SELECT form, venue_id FROM by_short UNION ALL SELECT form, venue_id FROM by_name)
  SELECT t.venue, m.venue_id FROM typed t JOIN mapped m ON t.form = m.form"""
_FOUND = """
  SELECT c.row_id, CAST(n.venue_id AS INT) AS venue_id FROM cases c JOIN named n ON c.venue = n.venue
  UNION ALL
  SELECT c.row_id, CAST(-1 AS INT) AS venue_id FROM cases c LEFT ANTI JOIN named n ON c.venue = n.venue"""


def spark_steps(k: int = MAX_EDITS) -> list[tuple[str, str]]:
    """Name and SQL of each table on the way, each written once; the last is the result."""
    segments = k + 1
    cut = f"(n DIV {segments})"
    near = f"""
WITH segments AS (
  SELECT form, venue_id, n, i, substring(form, (i - 1) * {cut} + 1, CASE WHEN i = {segments} THEN n ELSE {cut} END) AS piece
  FROM (SELECT form, venue_id, length(form) AS n, explode(sequence(1, {segments})) AS i FROM entry_forms)
  WHERE n >= {segments}
),
sized AS (
  SELECT form, n, i, length(form) - n AS d, (i - 1) * {cut} + 1 AS p, CASE WHEN i = {segments} THEN n - {k} * {cut} ELSE {cut} END AS size
  FROM (SELECT form, n, explode(sequence(1, {segments})) AS i
        FROM (SELECT f.form, explode(sequence(length(f.form) - {k}, length(f.form) + {k})) AS n FROM forms f LEFT ANTI JOIN by_short s ON f.form = s.form)
        WHERE n >= {segments})
),
placed AS (
  SELECT form, n, i, size, explode(sequence(low, high)) AS at
  FROM (SELECT *, greatest(1, p - (i - 1), p + d - ({segments} - i)) AS low, least(length(form) - size + 1, p + (i - 1), p + d + ({segments} - i)) AS high FROM sized)
  WHERE low <= high
),
candidates AS (
  SELECT DISTINCT v.form, s.form AS entry, s.venue_id FROM placed v JOIN segments s
  ON v.n = s.n AND v.i = s.i AND substring(v.form, v.at, v.size) = s.piece
)
SELECT form, venue_id, levenshtein(form, entry) AS edits FROM candidates WHERE levenshtein(form, entry, {k}) >= 0"""
    # the same principle over words for forms with words cut short: with less edits than words, and at most k, one word stays whole as far as it goes
    cut_short = f"""
WITH words AS (SELECT form, n, i + 1 AS i, word FROM (SELECT form, size(split(form, ' ')) AS n, posexplode(split(form, ' ')) AS (i, word) FROM forms)),
list_words AS (SELECT DISTINCT explode(split(form, ' ')) AS word FROM entry_forms),
beginnings AS (SELECT DISTINCT left(word, n) AS word FROM (SELECT word, explode(sequence({LEAST_LETTERS}, length(word) - 1)) AS n FROM list_words WHERE length(word) > {LEAST_LETTERS})),
abbreviated AS (SELECT DISTINCT w.form FROM words w LEFT SEMI JOIN beginnings b ON w.word = b.word LEFT ANTI JOIN list_words l ON w.word = l.word LEFT ANTI JOIN by_short s ON w.form = s.form),
pieces AS (SELECT form, n, i, left(word, {LEAST_LETTERS}) AS piece FROM words w LEFT SEMI JOIN abbreviated a ON w.form = a.form),
entry_pieces AS (
  SELECT form, venue_id, n, i + 1 AS i, left(word, {LEAST_LETTERS}) AS piece
  FROM (SELECT form, venue_id, size(split(form, ' ')) AS n, posexplode(split(form, ' ')) AS (i, word) FROM entry_forms)
),
candidates AS (
  SELECT DISTINCT p.form, e.form AS entry, e.venue_id, p.n FROM pieces p JOIN entry_pieces e ON p.n = e.n AND p.i = e.i AND p.piece = e.piece
)
SELECT form, venue_id, edits FROM (
  SELECT form, venue_id, n, aggregate(zip_with(split(form, ' '), split(entry, ' '), (t, e) -> {_word_cost("t", "e")}), 0, (a, b) -> a + b) AS edits FROM candidates
) WHERE edits <= least({k}, n - 1)"""
    return [
        ("typed", f"SELECT venue, {_form('venue', 'spark')} AS form FROM (SELECT DISTINCT r.venue FROM results r WHERE r.venue IS NOT NULL)"),
        ("entries", f"SELECT venue_id, {_form('venue_name', 'spark')} AS form FROM venue_list WHERE venue_name IS NOT NULL"),
        ("entry_forms", _entry_forms("spark", "entries")),
        ("forms", "SELECT DISTINCT form FROM typed"),
        ("by_short", _BY_SHORT),
        ("near_whole", near),
        ("near_cut", cut_short),
        ("near", "SELECT form, venue_id, edits FROM near_whole UNION ALL SELECT form, venue_id, edits FROM near_cut"),
        ("named", _NAMED),
        ("found", f"WITH cases AS ({_cases('spark')}) {_FOUND}"),
    ]


def duckdb_sql(k: int = MAX_EDITS) -> str:
    """The same result by comparing every value with every entry."""
    return f"""
WITH entries AS (SELECT venue_id, {_form("venue_name", "duckdb")} AS form FROM venue_list WHERE venue_name IS NOT NULL),
entry_forms AS ({_entry_forms("duckdb", "entries")}),
cases AS ({_cases("duckdb")}),
typed AS (SELECT venue, {_form("venue", "duckdb")} AS form FROM (SELECT DISTINCT venue FROM cases) AS d),
forms AS (SELECT DISTINCT form FROM typed),
by_short AS ({_BY_SHORT}),
list_words AS (SELECT DISTINCT unnest(string_split(form, ' ')) AS word FROM entry_forms),
abbreviated AS (
  SELECT DISTINCT form FROM (SELECT form, unnest(string_split(form, ' ')) AS word FROM forms WHERE form NOT IN (SELECT form FROM by_short)) AS w
  WHERE length(word) >= {LEAST_LETTERS} AND word NOT IN (SELECT word FROM list_words) AND EXISTS (SELECT 1 FROM list_words l WHERE starts_with(l.word, w.word))
),
near_cut AS (
  SELECT form, venue_id, edits FROM (
    SELECT a.form, e.venue_id, len(string_split(a.form, ' ')) AS n,
      list_sum(list_transform(list_zip(string_split(a.form, ' '), string_split(e.form, ' ')), lambda x: {_word_cost("x[1]", "x[2]")})) AS edits
    FROM abbreviated a, entry_forms e WHERE len(string_split(a.form, ' ')) = len(string_split(e.form, ' '))
  ) AS c WHERE edits <= least({k}, n - 1)
),
near AS (
  SELECT form, venue_id, edits FROM near_cut UNION ALL
  SELECT f.form, e.venue_id, levenshtein(f.form, e.form) AS edits FROM forms f, entry_forms e
  WHERE f.form NOT IN (SELECT form FROM by_short) AND abs(length(f.form) - length(e.form)) <= {k} AND length(e.form) > {k} AND levenshtein(f.form, e.form) <= {k}
),
named AS ({_NAMED})
{_FOUND.replace("LEFT ANTI JOIN", "ANTI JOIN")}"""


def map_venues(results: DataFrame, venue_list: DataFrame, k: int = MAX_EDITS) -> DataFrame:
    """row_id and venue_id of each row whose venue is typed freely; -1 where no entry is meant."""
    spark, mark = results.sparkSession, uuid.uuid4().hex
    space, views = Workspace(spark, "venues"), {}

    def over(sql: str) -> str:
        for name, view in views.items():
            sql = re.sub(rf"(?<=FROM |JOIN ){name}\b", view, sql)
        return sql

    def view(name: str, df: DataFrame) -> None:
        views[name] = f"kinsift_{mark}_{name}"
        df.createOrReplaceTempView(views[name])

    view("results", results.select("row_id", "venue"))
    view("venue_list", venue_list.select("venue_id", "venue_name", "short_name"))
    *steps, (_, last) = spark_steps(k)
    for name, sql in steps:
        view(name, space.write(spark.sql(over(sql))))
    out = spark.sql(over(last))
    for name in views.values():
        spark.catalog.dropTempView(name)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_venues(table(spark, sf_dir, "results"), table(spark, sf_dir, "venue_list"))
