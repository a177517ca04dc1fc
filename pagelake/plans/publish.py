"""Results built aside and put in place together; what is finished is not made again."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from pagelake.session import discard, exists, is_empty_folder, read_text, rename, write_text

_LONG = "spark.sql.debug.maxToStringFields"


def identity(spark: SparkSession, frames: Sequence[DataFrame], settings: object, version: str | None = None) -> str:
    """A digest of what a stage depends on: input files, plans, settings and ``version``.

    Files count by name, which Spark never gives twice; an input whose files are
    rewritten under one name, or that comes from no files, needs a ``version``.
    """
    parts = [repr(settings), version or ""]
    before = spark.conf.get(_LONG)
    spark.conf.set(_LONG, str(1 << 20))
    try:
        for df in frames:
            files = sorted(df.inputFiles())
            if not files and version is None:
                raise ValueError("inputs that do not come from files need a version")
            plan = df._jdf.queryExecution().analyzed().toString()
            plan = re.sub(r"lambda \w+#\d+L?", "lambda", plan)  # numbered anew in every session
            parts += [re.sub(r"#\d+L?", "", plan), *files]
    finally:
        spark.conf.set(_LONG, before)
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class Publication:
    """The results of one stage, below ``out``.

    Parts are written below ``out/_pending/<stage>``, each marked when it is finished.
    :meth:`commit` writes one file that names them all, and from then on the results are
    these parts: they are moved into place, and if the run dies while it moves them the
    next one goes on (:func:`recover`). Before that file is there, the results of the run
    before stay as they are.

    With ``inputs``, the :func:`identity` of the stage, parts that a dead run with the
    same inputs finished are kept, and a published stage is known by its manifest,
    ``out/_manifest/<stage>``. Without it everything is made anew and no manifest remains.
    """

    def __init__(self, spark: SparkSession, out: str, stage: str, inputs: str | None = None):
        self.spark, self.out, self.stage, self.inputs = spark, out, stage, inputs
        self.aside = f"{out}/_pending/{stage}"
        self.manifest = f"{out}/_manifest/{stage}"
        self.facts: dict = {}
        begun = read_text(spark, f"{self.aside}/inputs")
        if inputs is None or begun != inputs:
            discard(spark, self.aside)
            write_text(spark, f"{self.aside}/inputs", inputs or "")

    def path(self, name: str) -> str:
        """Where the part lies until it is published."""
        return f"{self.aside}/parts/{name}"

    def part(self, name: str, write: Callable[[str], dict | None]) -> None:
        """Let ``write(path)`` make a part, unless it is finished; keep the facts it returns."""
        mark = f"{self.aside}/finished/{name}"
        known = read_text(self.spark, mark)
        if known is None:
            discard(self.spark, self.path(name))
            known = json.dumps(write(self.path(name)) or {})
            write_text(self.spark, mark, known)
        self.facts |= json.loads(known)

    def abandon(self) -> None:
        """Leave the results as they were."""
        discard(self.spark, self.aside)
        _sweep(self.spark, f"{self.out}/_pending")

    def commit(self, names: Sequence[str], outdated: Sequence[str] = ()) -> None:
        """Publish the parts ``names``; results without a part, and ``outdated`` ones, go."""
        made = [n for n in names if exists(self.spark, self.path(n))]
        gone = [n for n in (*names, *outdated) if n not in made]
        record = {"made": made, "gone": gone, "inputs": self.inputs, "facts": self.facts}
        write_text(self.spark, f"{self.aside}/commit", json.dumps(record))
        recover(self.spark, self.out, self.stage)


def published(spark: SparkSession, out: str, stage: str, inputs: str | None) -> dict | None:
    """The facts of a stage that was published from the same inputs, else None."""
    text = read_text(spark, f"{out}/_manifest/{stage}") if inputs else None
    record = json.loads(text) if text else {}
    return record["facts"] if record.get("inputs") == inputs and inputs else None


def recover(spark: SparkSession, out: str, stage: str) -> None:
    """Finish moving the results of a committed stage into place, if there is one.

    Every step may be done twice: a part that is not there any more has been moved.
    """
    aside, manifest = f"{out}/_pending/{stage}", f"{out}/_manifest/{stage}"
    text = read_text(spark, f"{aside}/commit")
    if text is None:
        return
    record = json.loads(text)
    discard(spark, manifest)  # it names the results that are now replaced
    for name in record["gone"]:
        discard(spark, f"{out}/{name}")
    for name in record["made"]:
        if exists(spark, f"{aside}/parts/{name}"):
            discard(spark, f"{out}/{name}")
            rename(spark, f"{aside}/parts/{name}", f"{out}/{name}")
    if record["inputs"]:
        write_text(spark, manifest, text)
    discard(spark, aside)
    _sweep(spark, f"{out}/_pending")
    _sweep(spark, f"{out}/_manifest")


def _sweep(spark: SparkSession, folder: str) -> None:
    if is_empty_folder(spark, folder):
        discard(spark, folder)
