"""String functions as columns; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinel answers of failed calls.
SENTINELS = ("ERROR", "NO_ANSWER", "TIMEOUT")


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind (Unicode)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized(c: Column) -> Column:
    """Lower-cased and trimmed."""
    return F.lower(trimmed(c))


def is_nonempty(c: Column) -> Column:
    return F.coalesce(F.length(trimmed(c)) > 0, F.lit(False))


def words(c: Column) -> Column:
    """Whitespace-separated words; none for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4)


def first_nonempty(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def without_version(c: Column) -> Column:
    """The last path segment, up to its first ``v``."""
    return F.split_part(F.element_at(F.split(c, "/"), -1), F.lit("v"), F.lit(1))


def category_prefix(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def in_category(c: Column, target: str, is_sub: bool) -> Column:
    """A sub-category must be equal; a main category is the part before the dot."""
    return c == target if is_sub else c.startswith(target + ".")


def perturbed(c: Column) -> Column:
    """The fallback character mapping of perturbed problems."""
    return F.translate(c, "abc", "XYZ")


def file_safe(c: Column) -> Column:
    return F.translate(c, "/-", "__")


def listed(c: Column) -> Column:
    """A comma-separated argument as a list of trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def fenced(c: Column, language: str) -> Column:
    """The first fenced block of ``language``, else (where no such fence opens) of none, else null."""
    tick = "```"
    own = F.regexp_extract(c, f"(?s){tick}{language}\\n(.*?){tick}", 1)
    bare = F.regexp_extract(c, f"(?s){tick}\\n(.*?){tick}", 1)
    has_own, has_bare = c.rlike(f"(?s){tick}{language}\\n(.*?){tick}"), c.rlike(f"(?s){tick}\\n(.*?){tick}")
    return F.when(F.contains(c, F.lit(tick + language)), F.when(has_own, own)).when(F.contains(c, F.lit(tick)), F.when(has_bare, bare))


def code_block(c: Column) -> Column:
    """The response's code, trimmed: its first fenced block, else all of it."""
    return trimmed(F.coalesce(fenced(c, "python"), c))


def json_block(c: Column) -> Column:
    return F.coalesce(fenced(c, "json"), c)


def function_name(c: Column) -> Column:
    """The first function that the code defines, or null."""
    return F.nullif(F.regexp_extract(c, r"def\s+(\w+)\s*\(", 1), F.lit(""))


#: Where a final answer stands.
FINAL_ANSWER = (
    r"(?s)\\section\*\{Final Answer\}(.*?)(?:\\section|\z)",
    r"(?s)\\section\{Final Answer\}(.*?)(?:\\section|\z)",
    r"(?s)\\subsection\*\{Final Answer\}(.*?)(?:\\section|\\subsection|\z)",
    r"(?s)\\subsection\{Final Answer\}(.*?)(?:\\section|\\subsection|\z)",
    r"(?s)\[FINAL ANSWER\](.*?)\[/FINAL ANSWER\]",
)


def final_answer(c: Column) -> Column:
    return F.coalesce(*[F.nullif(trimmed(F.regexp_extract(c, p, 1)), F.lit("")) for p in FINAL_ANSWER], c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it; higher-order functions would repeat it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _locate(part: Column, c: Column) -> Column:
    return F.call_function("locate", part, c)


def _marker(i: Column) -> Column:
    return F.concat(F.lit("blank"), i.cast("string"), F.lit(":"))


def blanks(reply: Column, n: int | Column) -> Column:
    """Answers of ``blank1:`` .. ``blankN:`` in a reply, ``NO_ANSWER`` where the marker is missing.

    An answer ends at the nearest marker of a later number and is its first line.
    Markers are looked for without regard to case.
    """
    count = F.lit(n) if isinstance(n, int) else n

    def answer(rest: Column, i: Column) -> Column:
        later = F.filter(F.transform(F.filter(F.sequence(F.lit(1), count), lambda j: j > i), lambda j: _locate(_marker(j), F.lower(rest))), lambda p: p > 0)
        end = F.coalesce(F.array_min(later) - 1, F.length(rest))
        return trimmed(F.split_part(trimmed(F.substring(rest, F.lit(1), end)), F.lit("\n"), F.lit(1)))

    def one(t: Column, i: Column) -> Column:
        rest = lambda at: trimmed(F.substring(t["reply"], at + F.length(_marker(i)), F.length(t["reply"])))
        return let(_locate(_marker(i), t["low"]), lambda at: F.when(at > 0, let(rest(at), lambda r: answer(r, i))).otherwise(F.lit("NO_ANSWER")))

    return let(F.struct(reply.alias("reply"), F.lower(reply).alias("low")), lambda t: F.transform(F.sequence(F.lit(1), count), lambda i: one(t, i)))


def cloze_is_valid(question: Column, answers: Column, least: int, most: int) -> Column:
    """Every blank is marked in the question, and every answer has 2 characters or more and ``least`` to ``most`` words."""
    marked = F.forall(F.sequence(F.lit(1), F.greatest(F.size(answers), F.lit(1))), lambda i: F.contains(F.lower(question), F.concat(F.lit("[blank"), i.cast("string"), F.lit("]"))))
    good = F.forall(answers, lambda a: (F.length(trimmed(a)) > 1) & word_count(a).between(least, most))
    return F.coalesce(is_nonempty(question) & (F.size(answers) > 0) & marked & good, F.lit(False))


def prompt(template: str, **values: Column) -> Column:
    """A prompt from a template with ``{name}`` places; null values render as empty."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))
