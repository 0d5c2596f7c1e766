"""The chain of export attempts of a document: which are planned, and what comes of them within one deadline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lookups as L

#: What a failed export says when a file's name keeps it from being read, and the errors of a chain.
NOT_LOADED = "source file could not be loaded"
KILLED, EXITED, NO_OUTPUT = "soffice killed (timeout?): ", "soffice exited ", "soffice produced no PDF"
SPENT, FAILED = "soffice fallback budget exhausted", "conversion failed"


def export_filter(label: Column) -> Column:
    app = L.application_of(label)
    return F.when(app == "calc", L.ONE_PAGE_SHEETS).otherwise(F.concat(app, F.lit("_pdf_Export")))


def filters_to_try(label: Column) -> Column:
    """Export filters in order: the label's own, for sheets the same without a page a sheet, then writer's."""
    label = F.lower(label)
    plain = F.when(L.application_of(label) == "calc", "calc_pdf_Export")
    return F.array_distinct(F.array_compact(F.array(export_filter(label), plain, F.lit("writer_pdf_Export"))))


def needs_rename(label: Column, ext: Column) -> Column:
    """Whether a file is staged under its label's name: its content is of another family than its name."""
    return (L.family_of(label) != L.family_of(ext)) & (label != ext)


def staged_name(stem: Column, label: Column, ext: Column) -> Column:
    return F.concat(stem, F.lit("."), F.when(needs_rename(label, ext), label).otherwise(ext))


def planned_attempts(label: Column, ext: Column, original: Column, prepared: Column, preserve: Column) -> Column:
    """Attempts in order: step, again (a second try of the step under the original name), filter and name.

    prepared is the name the file has once it is staged and made ready; preserve says that only that form may be
    exported. Otherwise steps after the first take the original, and the first step of a renamed file may
    be tried again with it."""
    twice = needs_rename(label, ext) & (prepared != original) & ~preserve
    late = F.when(preserve, prepared).otherwise(original)

    def attempt(step: Column, again: bool, by: Column, name: Column) -> Column:
        return F.struct(step.cast("int").alias("step"), F.lit(again).alias("again"), by.alias("filter"), name.alias("name"))

    def of(by: Column, i: Column) -> Column:
        one = attempt(i, False, by, F.when(i == 0, prepared).otherwise(late))
        return F.when((i == 0) & twice, F.array(one, attempt(i, True, by, original))).otherwise(F.array(one))

    return F.flatten(F.transform(filters_to_try(label), of))


def run_chain(attempts: Column, outcomes: Column, timeout_s: int) -> Column:
    """What a chain comes to: ok, filter and name of the attempt that gave a file, tried, elapsed, error, error_class.

    outcomes has what each planned attempt would give, in the same order: seconds, killed, exit_code, stderr and
    made (whether there is a file). One deadline holds for the whole chain: the first attempt always runs, and
    later ones only before it. A step is tried again under the original name only if its first try could not
    load the file. An attempt without outcome ends the chain."""
    deadline = F.lit(float(max(1, timeout_s)))
    none = F.lit(None).cast("string")
    state = F.struct(
        F.lit(0.0).alias("elapsed"), F.lit(False).alias("over"), F.lit(False).alias("retry"), F.lit(False).alias("ok"),
        F.lit(0).alias("tried"), none.alias("error"), none.alias("filter"), none.alias("name"),
    )

    def step(s: Column, x: Column) -> Column:
        a, o = x["a"], x["o"]
        late = s["elapsed"] >= deadline
        stop = ~s["over"] & (o.isNull() | (~a["again"] & (a["step"] > 0) & late))
        run = ~s["over"] & ~stop & F.when(a["again"], s["retry"] & ~late).otherwise(True)
        failed = o["exit_code"] != 0
        done = run & ~o["killed"] & ~failed & o["made"]
        text = F.coalesce(o["stderr"], F.lit(""))
        error = F.when(o["killed"], F.concat(F.lit(KILLED), text)).when(failed, F.concat(F.lit(EXITED), o["exit_code"].cast("string"), F.lit(": "), text)).when(~o["made"], NO_OUTPUT)
        retry = run & ~a["again"] & ~o["killed"] & failed & F.lower(text).contains(NOT_LOADED)
        return F.struct(
            (s["elapsed"] + F.when(run, o["seconds"]).otherwise(0.0)).alias("elapsed"),
            (s["over"] | stop | done).alias("over"),
            F.coalesce(retry, F.lit(False)).alias("retry"),
            (s["ok"] | F.coalesce(done, F.lit(False))).alias("ok"),
            (s["tried"] + run.cast("int")).alias("tried"),
            F.when(run, F.when(done, s["error"]).otherwise(error)).when(stop & o.isNotNull(), F.coalesce(s["error"], F.lit(SPENT))).otherwise(s["error"]).alias("error"),
            F.when(done, a["filter"]).otherwise(s["filter"]).alias("filter"),
            F.when(done, a["name"]).otherwise(s["name"]).alias("name"),
        )

    def finish(s: Column) -> Column:
        error = F.when(~s["ok"], F.coalesce(s["error"], F.lit(FAILED)))
        empty = ~error.contains("killed") & error.contains("no PDF")
        kind = F.when(error.isNotNull(), F.when(empty, "empty_output").otherwise("error"))
        return F.struct(s["ok"].alias("ok"), s["filter"].alias("filter"), s["name"].alias("name"), s["tried"].alias("tried"), s["elapsed"].alias("elapsed"), error.alias("error"), kind.alias("error_class"))

    pairs = F.zip_with(attempts, F.slice(outcomes, F.lit(1), F.size(attempts)), lambda a, o: F.struct(a.alias("a"), o.alias("o")))
    return F.aggregate(pairs, state, step, finish)
