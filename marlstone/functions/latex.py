"""Reading LaTeX: comments, sections, statements and their context, as columns.

All but the two line-state comment strippers are JVM expressions. Positions count
characters from 0.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What starts an appendix.
APPENDIX = (r"\\appendix", r"\\section\{Appendix\}", r"\\section\{Appendices\}", r"\\section\{\s*A\s+.*?\}", r"\\section\{.*?Appendix.*?\}", r"\\begin\{appendix\}", r"\\part\{Appendix\}")
#: Signs of numbering by section; the last two in a working form.
SECTION_NUMBERING = (
    r"\\numberwithin\{theorem\}\{section\}", r"\\numberwithin\{thm\}\{section\}",
    r"\\renewcommand\{\\thethm\}\{\\thesection\.\\arabic\{thm\}\}", r"\\renewcommand\{\\thetheorem\}\{\\thesection\.\\arabic\{theorem\}\}",
    r"\\newtheorem\{theorem\}\{Theorem\}\[section\]",
)
#: Definitions of commands.
COMMANDS = (r"\\newcommand\{\\[^}]+\}(?:\[\d+\])?\{[^}]+\}", r"\\DeclareMathOperator\{\\[^}]+\}\{[^}]+\}", r"\\def\\[A-Za-z0-9]+(?:\[[^\]]*\])?\{[^}]+\}", r"\\renewcommand\{\\[^}]+\}(?:\[\d+\])?\{[^}]+\}")
#: Where a statement's number may stand, within NEAR characters of it.
NUMBERS = (
    r"(?i)\\label\{(?:theorem|thm)(?::|_|-)([0-9.]+)\}", r"(?i)\\label\{(?:th|theorem|Theorem):?([0-9.]+(?:\.[0-9]+)?)\}", r"(?i)\\tag\{\(?([^}]+)\)?\}",
    r"(?i)(?:Theorem|theorem)[\s~]*(?:\\ref\{[^}]*\}|([0-9.]+))", r"(?i)(?:Theorem|theorem)[\s~]*([0-9]+\.[0-9]+)", r"(?i)(?:Theorem|theorem)[\s~]*([0-9]+)",
)
NEAR = 1000
#: Sections, declared environments and labels.
SECTION = r"\\section\s*(?:\[.*?\])?\s*\{([^}]*)\}"
NEWTHEOREM = r"\\newtheorem\{([^}]+)\}\{([^}]+)\}"
LABEL = r"\\label\{(.*?)\}"


def remove_comments(c: Column) -> Column:
    """Comments by pattern: from an unescaped ``%`` to the line's end; blank lines collapse."""
    c = F.replace(c, F.lit("\\%"), F.lit("\x01"))
    c = F.regexp_replace(c, r"%[^\n]*(?:\n|\z)", "\n")
    c = F.replace(c, F.lit("\x01"), F.lit("\\%"))
    return F.regexp_replace(c, r"\n\s*\n+", "\n\n")


_LINES = re.compile(r"[^\n]*\n|[^\n]+")


def _strip(text: str | None, keep_ends: bool) -> str | None:
    """Comment environments, ``\\iffalse`` blocks and ``%`` comments by a line-state machine.

    Within a line an opening marker is looked at before a closing one, ``%`` counts
    unless escaped, inside an open ``$`` or directly inside ``\\{``. With ``keep_ends``
    a cut comment takes the line's end with it, and all kinds of line ends become line feeds.
    """
    if text is None:
        return None
    out, inside = [], False
    if keep_ends:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    for line in _LINES.findall(text) if keep_ends else text.split("\n"):
        opens = [p for p in (line.find("\\begin{comment}"), line.find("\\iffalse")) if p >= 0]
        if opens:
            inside = True
            if min(opens) > 0:
                out.append(line[: min(opens)])
            continue
        closes = [line.find(m) + len(m) for m in ("\\end{comment}", "\\fi") if m in line]
        if closes:
            inside = False
            if line[max(closes) :]:
                out.append(line[max(closes) :])
            continue
        if inside or line.strip().startswith("%"):
            continue
        at = line.find("%")
        if at >= 0:
            head = line[:at]
            escaped = (len(head) - len(head.rstrip("\\"))) % 2 == 1
            if not (escaped or head.count("$") % 2 or head.endswith("\\{")):
                line = head
        out.append(line)
    return ("" if keep_ends else "\n").join(out)


@F.pandas_udf(T.StringType())
def strip_comments(s: pd.Series) -> pd.Series:
    """The state machine over lines that keep their ends. Arrow batches; linear in the text."""
    return s.map(lambda t: _strip(t, True))


@F.pandas_udf(T.StringType())
def strip_comments_text(s: pd.Series) -> pd.Series:
    """The state machine over lines joined again by line feeds."""
    return s.map(lambda t: _strip(t, False))


def appendix_start(c: Column) -> Column:
    """Position (from 1) of the first sign of an appendix, or null."""
    return F.least(*[F.nullif(F.regexp_instr(c, F.lit("(?i)" + p)), F.lit(0)) for p in APPENDIX])


def without_appendix(c: Column) -> Column:
    start = appendix_start(c)
    return F.when(start.isNull(), c).otherwise(F.substring(c, F.lit(1), start - 1))


def numbered_by_section(c: Column) -> Column:
    return c.rlike("|".join(SECTION_NUMBERING))


def match_spans(c: Column, pattern: Column | str) -> Column:
    """array<struct<match, start, end>> of all matches, in order."""
    found = F.regexp_extract_all(c, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int,end:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        start = F.call_function("locate", m, c, acc["at"] + 1) - 1
        end = start + F.length(m)
        return F.struct(end.cast("int").alias("at"), F.concat(acc["spans"], F.array(F.struct(m.alias("match"), start.cast("int").alias("start"), end.cast("int").alias("end")))).alias("spans"))

    return F.aggregate(found, empty, step)["spans"]


def sections(c: Column) -> Column:
    """array<struct<number, position, title>>; a title that starts with a number sets the counter."""
    spans = match_spans(c, SECTION)
    titled = F.transform(spans, lambda s: F.struct(s["start"].alias("position"), F.regexp_extract(s["match"], SECTION, 1).alias("title")))
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<number:int,position:int,title:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        told = F.regexp_extract(s["title"], r"^(\d{1,9})[.\s]+", 1).try_cast("int")
        n = F.when(told > 0, told).otherwise(acc["n"] + 1)
        return F.struct(n.cast("int").alias("n"), F.concat(acc["out"], F.array(F.struct(n.cast("int").alias("number"), s["position"].alias("position"), s["title"].alias("title")))).alias("out"))

    return F.aggregate(titled, empty, step)["out"]


def theorem_environments(c: Column) -> Column:
    """Names of environments declared by ``\\newtheorem`` whose name or display mentions theorems."""
    names, shown = F.regexp_extract_all(c, F.lit(NEWTHEOREM), F.lit(1)), F.regexp_extract_all(c, F.lit(NEWTHEOREM), F.lit(2))
    both = F.arrays_zip(names.alias("name"), shown.alias("shown"))
    wanted = F.filter(both, lambda e: F.contains(F.lower(e["name"]), F.lit("theorem")) | F.contains(F.lower(e["shown"]), F.lit("theorem")))
    return F.array_distinct(F.transform(wanted, lambda e: e["name"]))


def environment_pattern(c: Column) -> Column:
    """Pattern of the statement environments of a text: ``theorem`` and its declared ones."""
    quoted = F.transform(F.array_union(F.array(F.lit("theorem")), theorem_environments(c)), lambda e: F.concat(F.lit(r"\Q"), e, F.lit(r"\E")))
    return F.concat(F.lit(r"(?s)\\begin\{("), F.array_join(quoted, "|"), F.lit(r")\}(.*?)\\end\{\1\}"))


def statements(c: Column) -> Column:
    """array<struct<env, number, label, content, start, end>>: all statements; number and label null where not given."""
    pattern = environment_pattern(c)

    def one(s: Column) -> Column:
        env = F.regexp_extract(s["match"], r"^\\begin\{([^}]*)\}", 1)
        body = F.regexp_extract(s["match"], r"(?s)^\\begin\{[^}]*\}(.*)\\end\{[^}]*\}$", 1)
        number = F.nullif(F.trim(F.regexp_extract(body, r"^\[([^\]]+)\]", 1)), F.lit(""))
        content = F.regexp_replace(body, r"^\[[^\]]+\]", "")
        label = F.nullif(F.regexp_extract(content, LABEL, 1), F.lit(""))
        return F.struct(env.alias("env"), number.alias("number"), label.alias("label"), F.regexp_replace(F.regexp_replace(content, LABEL, ""), r"^\s+|\s+$", "").alias("content"), s["start"].alias("start"), s["end"].alias("end"))

    return F.transform(match_spans(c, pattern), one)


def nearby_number(text: Column, start: Column, end: Column, label: Column) -> Column:
    """A plain statement's number as told nearby: by reference, label, tag or wording, else digits of its label, or null."""
    low = F.greatest(start - NEAR, F.lit(0))
    near = F.substring(text, low + 1, end + NEAR - low)
    quoted = F.concat(F.lit(r"(?i)\\ref\{\Q"), label, F.lit(r"\E\}[\s\n]*([0-9.]+)"))
    told = [F.when(label.isNotNull(), F.nullif(F.call_function("regexp_extract", near, quoted, F.lit(1)), F.lit("")))]
    told += [F.nullif(F.regexp_extract(near, p, 1), F.lit("")) for p in NUMBERS]
    return F.coalesce(*told, F.nullif(F.regexp_extract(label, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")))


def counters(found: Column) -> Column:
    """The running number of each of a text's statements among those of its environment."""
    return F.transform(found, lambda s, i: F.size(F.filter(F.slice(found, F.lit(1), i + 1), lambda x: x["env"] == s["env"])))


def display_name(c: Column, env: Column) -> Column:
    """What a statement is called: its environment's declared name, ``Theorem`` for the standard one."""
    own = F.concat(F.lit(r"\\newtheorem\{\Q"), env, F.lit(r"\E\}\{([^}]+)\}"))
    return F.when(env != "theorem", F.nullif(F.call_function("regexp_extract", c, own, F.lit(1)), F.lit(""))).otherwise(F.lit("Theorem"))


def plain_number(text: Column, s: Column, counter: Column, sections_: Column) -> Column:
    """A plain statement's number: told nearby, else section and counter where ``sections_`` (null unless numbered by section) has a section before it, else the counter."""
    section = section_at(sections_, s["start"])
    return F.coalesce(nearby_number(text, s["start"], s["end"], s["label"]), F.concat(section["number"].cast("string"), F.lit("."), counter.cast("string")), counter.cast("string"))


def section_at(sections_: Column, position: Column) -> Column:
    """The last section that starts before a position (an as-of lookup in the ordered array), or null."""
    return F.try_element_at(F.filter(sections_, lambda s: s["position"] < position), F.lit(-1))


def prefix_context(c: Column, start: Column) -> Column:
    """All text before a position, white space collapsed."""
    return F.trim(F.regexp_replace(F.substring(c, F.lit(1), start), r"(?U)\s+", " "))


def commands(c: Column) -> Column:
    """Definitions of commands, one a line."""
    return F.array_join(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in COMMANDS]), "\n")


def includes(c: Column) -> Column:
    return F.concat(F.regexp_extract_all(c, F.lit(r"\\input\{([^}]+)\}"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"\\include\{([^}]+)\}"), F.lit(1)))


def has_document_marker(c: Column) -> Column:
    return F.contains(c, F.lit("\\documentclass")) | F.contains(c, F.lit("\\begin{document}"))
