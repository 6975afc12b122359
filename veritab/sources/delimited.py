"""Delimited text records: a recursive-descent grammar that recovers from errors.

    record    := field (delimiter field)*
    field     := quoted | plain
    quoted    := '"' (any character but '"' | '""')* '"'
    plain     := (any character but '"' and delimiter)*

A record that breaks the grammar gives a located error, and ``recover`` resumes at the next record start: the next given one where
the source names them, else the next *validated anchor*, a line start whose first field matches the anchor pattern and from which a
whole record parses with the right number of fields; what lies before stays one failed record.

* ``parse_lines``: a table of one record per row.  Row starts are the anchors, and line breaks outside quotes are ordinary
  characters.  Good records without a quote are told by one pattern and split by Spark's own functions; all others of a batch are
  one text for the grammar.
* ``parse_files``: whole files as text, cut into chunks of lines.  A chunk is parsed from its first validated anchor to that of the
  next chunk, which it sees as well, so a large file is many tasks.

Defined results: a null or empty record fails as ``columns``; a file without a header has the delimiter ``,``; a header sent
twice counts once; records sent twice give a row each; very long records are parsed in one pass; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.shared import ensure_checkpoint_dir

#: Files whose delimiters may be broadcast (some 10 MB).
MAX_BROADCAST_FILES = 100_000
MISSING = frozenset(("", "NA", "N/A", "null", "NaN"))
NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?")
DIGITS = re.compile(r"[0-9]+")
COLUMNS = ("order_id", "date", "product", "category", "revenue", "quantity", "customer_email")


class Broken(ValueError):
    def __init__(self, what: str, at: int):
        super().__init__(f"{what} at {at}")
        self.what, self.at = what, at


class Grammar:
    """One descent over ``text``; ``stop`` holds the characters that end a record."""

    def __init__(self, text: str, delimiter: str, stop: str = ""):
        self.text, self.delimiter, self.stop = text, delimiter, stop
        self.plain = re.compile(f"[^\"{re.escape(delimiter + stop)}]*")
        self.last_quote = text.rfind('"')

    def record(self, at: int, end: int | None = None) -> tuple[list[str], int]:
        """The fields of the record at ``at`` and where it ends, at ``end`` at the latest."""
        end = len(self.text) if end is None else end
        value, at = self.field(at, end)
        fields = [value]
        while at < end and self.text[at] == self.delimiter:
            value, at = self.field(at + 1, end)
            fields.append(value)
        return fields, at

    def field(self, at: int, end: int) -> tuple[str, int]:
        if at < end and self.text[at] == '"':
            return self.quoted(at, end)
        stop = self.plain.match(self.text, at, end).end()
        if stop < end and self.text[stop] == '"':
            raise Broken("quote inside a plain field", stop)
        return self.text[at:stop], stop

    def quoted(self, at: int, limit: int) -> tuple[str, int]:
        parts, start = [], at + 1
        while True:
            end = self.text.find('"', start, limit) if start <= self.last_quote else -1
            if end < 0:
                raise Broken("quote not closed", at)
            if end + 1 < limit and self.text[end + 1] == '"':
                parts.append(self.text[start : end + 1])
                start = end + 2
                continue
            parts.append(self.text[start:end])
            end += 1
            if end < limit and self.text[end] != self.delimiter and self.text[end] not in self.stop:
                raise Broken("text after the closing quote", end)
            return "".join(parts), end


@dataclass
class Parsed:
    start: int
    fields: list[str] | None
    reason: str | None = None
    at: int | None = None


class Anchors:
    """Record starts of a text: the given ones, or line starts that are validated as they are asked for."""

    def __init__(self, grammar: Grammar, columns: int, pattern: str | None = None, given: list[int] | None = None):
        self.grammar, self.columns, self.given = grammar, columns, given
        self.lines = re.compile(f"^(?:{pattern})(?={re.escape(grammar.delimiter)})", re.M) if pattern else None

    def next(self, at: int) -> int:
        """The first record start at or after ``at``, or the end of the text."""
        if self.given is not None:
            k = bisect_left(self.given, at)
            return self.given[k] if k < len(self.given) else len(self.grammar.text)
        for m in self.lines.finditer(self.grammar.text, at):
            try:
                fields, _ = self.grammar.record(m.start())
            except Broken:
                continue
            if len(fields) == self.columns:
                return m.start()
        return len(self.grammar.text)


def recover(grammar: Grammar, anchors: Anchors, columns: int, at: int = 0, end: int | None = None) -> Iterator[Parsed]:
    """The records from ``at`` to ``end``; after an error the parser resumes at the next anchor."""
    text, end = grammar.text, len(grammar.text) if end is None else end
    while at < end:
        # a given anchor ends a record; in a stream the grammar finds the end itself
        limit = anchors.next(at + 1) if anchors.given is not None else len(text)
        close = limit - (anchors.given is not None)  # given records have a line end each
        if anchors.given is not None and close > at and text[close - 1] == "\r":
            close -= 1
        try:
            fields, stop = grammar.record(at, close)
            bad = len(fields) != columns
            yield Parsed(at, fields, "columns" if bad else None, len(fields) if bad else None)
        except Broken as e:
            yield Parsed(at, None, "quoting", e.at - at)
            stop = None
        if stop is None or anchors.given is not None:
            at = anchors.next(at + 1)
            continue
        at = stop + text.startswith("\r", stop)
        at += text.startswith("\n", at)


def parse_stream(text: str, delimiter: str, columns: int, anchor: str) -> list[Parsed]:
    """All records of a text with line ends as record ends."""
    grammar = Grammar(text, delimiter, "\r\n")
    return list(recover(grammar, Anchors(grammar, columns, anchor), columns))


def parse_records(raws: list[str], delimiter: str, columns: int = len(COLUMNS)) -> list[Parsed]:
    """One result for each of the given records, which are the anchors of one text."""
    at, starts = 0, []
    for raw in raws:
        starts.append(at)
        at += len(raw) + 1
    grammar = Grammar("".join(r + "\n" for r in raws), delimiter)
    return list(recover(grammar, Anchors(grammar, columns, given=starts), columns))


def revenue_of(field: str) -> tuple[float | None, bool]:
    value = field.strip(" ")
    if value in MISSING:
        return None, True
    return (float(value), True) if NUMBER.fullmatch(value) else (None, False)


def quantity_of(field: str) -> tuple[int | None, bool]:
    value = field.strip(" ")
    if value in MISSING:
        return None, True
    digits = value.lstrip("0") if DIGITS.fullmatch(value) else ""
    return (int(digits), True) if digits and len(digits) <= 6 and int(digits) <= 100_000 else (None, False)


TYPED = (
    "line_id long, file_name string, line_no long, reason string, error_at long, order_id string, date string, "
    "product string, category string, revenue double, quantity long, customer_email string"
)


def _typed(p: Parsed) -> tuple:
    """reason, error_at and the typed fields."""
    if p.reason is None:
        revenue, revenue_ok = revenue_of(p.fields[4])
        quantity, quantity_ok = quantity_of(p.fields[5])
        if revenue_ok and quantity_ok:
            return None, None, *p.fields[:4], revenue, quantity, p.fields[6]
        return ("revenue", 5) + (None,) * len(COLUMNS) if not revenue_ok else ("quantity", 6) + (None,) * len(COLUMNS)
    return (p.reason, p.at) + (None,) * len(COLUMNS)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    for c in {"line_no", "error_at", "quantity"} & set(columns):
        frame[c] = frame[c].astype("Int64")
    return frame


def _headers(lines: DataFrame) -> DataFrame:
    """(file_name, delimiter), broadcast if few: counted before, so that the lines need no shuffle; else Spark joins by file and splits hot files."""
    marks = lambda c: F.length(F.col("raw")) - F.length(F.replace(F.col("raw"), F.lit(c), F.lit("")))
    headers = lines.where(F.col("line_no") == 1).groupBy("file_name").agg(
        F.min_by(F.when(marks(";") > marks(","), ";").otherwise(","), F.struct("line_id")).alias("delimiter")
    )
    ensure_checkpoint_dir(lines.sparkSession)
    headers = headers.checkpoint()
    return F.broadcast(headers) if headers.count() <= MAX_BROADCAST_FILES else headers


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed fields, or reason and place of the error, of every record but the headers."""
    rows = (
        lines.where(~F.col("line_no").eqNullSafe(F.lit(1))).select("line_id", "file_name", "line_no", "raw")
        .join(_headers(lines), "file_name", "left").fillna(",", ["delimiter"]).withColumn("raw", F.coalesce("raw", F.lit("")))
    )
    good = F.when(F.col("delimiter") == ";", F.col("raw").rlike(_good(";"))).otherwise(F.col("raw").rlike(_good(",")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for delimiter, own in pdf.groupby("delimiter", sort=False):
                parsed = parse_records(own["raw"].tolist(), delimiter)
                out += [(line, name, no, *_typed(p)) for line, name, no, p in zip(own["line_id"], own["file_name"], own["line_no"], parsed)]
            yield _frame(out, ["line_id", "file_name", "line_no", "reason", "error_at", *COLUMNS])

    return _plain(rows.where(good)).unionByName(rows.where(~good).mapInPandas(run, TYPED))


def _good(d: str) -> str:
    """Records without quotes that have the right number of fields, a valid revenue and a valid quantity."""
    field, missing = f'[^{d}"]*+', "|".join(re.escape(m) for m in sorted(MISSING) if m)
    return rf"\A(?:{field}{d}){{4}} *+(?:-?[0-9]++(?:\.[0-9]++)?|{missing})?+ *+{d} *+(?:0*+(?:100000|[1-9][0-9]{{0,4}})|{missing})?+ *+{d}{field}\z"


def _plain(rows: DataFrame) -> DataFrame:
    """Good records without quotes, typed by built-in functions; their fields are cut once, in one projection."""
    text = F.regexp_replace("raw", r"\r\z", "")
    fields = F.when(F.col("delimiter") == ";", F.split(text, ";", -1)).otherwise(F.split(text, ",", -1))
    number = lambda k, kind: F.trim(F.get(fields, F.lit(k))).try_cast(kind)
    values = [F.get(fields, F.lit(k)) for k in range(4)]
    revenue = F.when(~F.trim(F.get(fields, F.lit(4))).isin("NaN"), number(4, "double"))  # the other signs of absence are no numbers
    values += [revenue, number(5, "long"), F.get(fields, F.lit(6))]
    none = [F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("error_at")]
    return rows.select("line_id", "file_name", F.col("line_no").cast("long").alias("line_no"), *none, *[v.alias(c) for c, v in zip(COLUMNS, values)])


FILE_FIELDS = (
    "file_name string, line_no long, lines long, reason string, error_at long, order_id string, date string, product string, category string, "
    "revenue double, quantity long, customer_email string"
)


def parse_files(lines: DataFrame, anchor: str, chunk: int = 20_000) -> DataFrame:
    """Records of whole files, the rows in their order being the files' text: where each starts, the rows it reaches over, and its fields or error.

    A chunk holds ``chunk`` line numbers and sees the next chunk; a failed record that reaches over a whole chunk without any valid one ends
    with that chunk.  The header is left out.
    """
    part = F.floor((F.coalesce("line_no", F.lit(0)) - 1) / chunk)
    rows = lines.select("file_name", "line_no", "line_id", F.coalesce("raw", F.lit("")).alias("raw"), part.alias("part")).where(~F.col("line_no").eqNullSafe(F.lit(1)))
    first = rows.groupBy("file_name").agg(F.min("part").alias("first"))
    # each row once in its own chunk and once as what the chunk before it sees
    both = rows.select("file_name", "line_no", "line_id", "raw", F.explode(F.array(F.struct(F.col("part").alias("at"), F.lit(False).alias("ahead")), F.struct((F.col("part") - 1).alias("at"), F.lit(True).alias("ahead")))).alias("s")).select("*", "s.*").drop("s")
    both = both.join(_headers(lines), "file_name", "left").fillna(",", ["delimiter"]).join(first, "file_name")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["file_name", "line_no", "lines", "reason", "error_at", *COLUMNS]
        pdf = pdf.sort_values(["ahead", "line_no", "line_id"], kind="stable")
        own = int((~pdf["ahead"]).sum())
        if not own:
            return _frame([], columns)
        raws = pdf["raw"].tolist()
        starts = [0, *accumulate(len(r) + 1 for r in raws)]
        grammar = Grammar("\n".join(raws), pdf["delimiter"].iloc[0], "\r\n")
        anchors = Anchors(grammar, len(COLUMNS), anchor)
        at = 0 if pdf["at"].iloc[0] == pdf["first"].iloc[0] else anchors.next(0)
        end = anchors.next(starts[own]) if own < len(raws) else len(grammar.text)
        numbers, out = pdf["line_no"].tolist(), []
        found = list(recover(grammar, anchors, len(COLUMNS), at, end)) if at < starts[own] else []
        for p, after in zip(found, [*(q.start for q in found[1:]), end]):
            k = bisect_right(starts, p.start) - 1
            out.append((pdf["file_name"].iloc[0], numbers[k], bisect_left(starts, after) - k, *_typed(p)))
        return _frame(out, columns)

    return both.groupBy("file_name", "at").applyInPandas(run, FILE_FIELDS)
