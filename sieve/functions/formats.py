"""Formatting Column expressions: report texts, link and study lines, labels."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ASSESSMENT_HEAD, ASSESSMENT_TAIL, CONTENT_COLUMNS, CONTENT_SECTIONS, LIKERT_LABELS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_str(c) -> Column:
    """Text as Python's ``str()`` prints it: NULL → ``None``."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def section_text(sections: Sequence[str] = ("tldr", "abstract"), prefix: str = "") -> Column:
    """``"<name>:\\n<value>\\n"`` per chosen section, in the fixed section order,
    joined by a newline; sections that are not content columns are skipped."""
    wanted = [s for s in CONTENT_SECTIONS if s in set(sections) and s in CONTENT_COLUMNS]
    parts = [F.concat(F.lit(f"{s}:\n"), py_str(F.col(prefix + s)), F.lit("\n")) for s in wanted]
    if not parts:
        return F.lit("")
    return F.concat_ws("\n", *parts)


def numbered(items) -> Column:
    """``array<string>`` → ``"1. a\\n2. b"``."""
    return F.array_join(F.transform(_c(items), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")


def assessment_instruction(criteria) -> Column:
    """The fixed rating instruction around the numbered criteria."""
    return F.concat(F.lit(ASSESSMENT_HEAD), numbered(criteria), F.lit(ASSESSMENT_TAIL))


def pdf_link_line(title="title", pdf="pdf_source", publisher="publisher_source") -> Column:
    """``Paper Title: <title> | Link: <pdf, else publisher>``; empty pdf counts as absent."""
    link = F.when(F.coalesce(_c(pdf), F.lit("")) != "", _c(pdf)).otherwise(py_str(publisher))
    return F.concat(F.lit("Paper Title: "), py_str(title), F.lit(" | Link: "), link)


def study_line(date="study_date", sid="study_id", papers="papers_collected", reports="reports_collected") -> Column:
    return F.concat(F.lit("Date "), py_str(date), F.lit(" | ID: "), py_str(sid),
                    F.lit(" | Papers: "), py_str(papers), F.lit(" | Reports: "), py_str(reports))


def likert_label(rating) -> Column:
    """Rating 1..7 → label; anything else → NULL."""
    r = _c(rating)
    expr = F.when(r == 1, F.lit(LIKERT_LABELS[0]))
    for i, lab in enumerate(LIKERT_LABELS[1:], start=2):
        expr = expr.when(r == i, F.lit(lab))
    return expr
