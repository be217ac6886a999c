"""P3 — engines by name, own ones included, each isolated from the others.

Built-in engines are column expressions that run fused in one pass.  A custom
engine is a Python function of a page (a dict of its extracted columns) that
yields findings as dicts; all custom engines of a run share one Python table
function, called once a page.  An engine that fails costs its own findings only:
a custom one on the page where it raised, a built-in one whose expression cannot
be built or analysed in the whole run.  Each failure is a row of the error channel,
as is a page that did not parse."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from trapline.functions import fixed
from trapline.operators.detectors import engines as E
from trapline.session import materialize

Engine = Callable[[dict], Iterable[dict]]
#: Registered custom engines by name.
CUSTOM: dict[str, Engine] = {}
REQUIRED = ("type", "category", "severity", "confidence")
_ROW = T.StructType([T.StructField(n, t) for n, t in (
    ("engine", T.StringType()), ("n", T.LongType()), ("type", T.StringType()), ("category", T.StringType()), ("severity", T.StringType()),
    ("confidence", T.DoubleType()), ("element", T.StringType()), ("evidence", T.StringType()), ("description", T.StringType()),
    ("recommendation", T.StringType()), ("legal_refs", T.ArrayType(T.StringType())), ("is_critical", T.BooleanType()), ("error", T.StringType()))])


def register(name: str, engine: Engine) -> None:
    """Add a custom engine; a built-in engine's name is refused."""
    if name in E.ENGINES or name in fixed.ENGINE_ORDER:
        raise ValueError(f"{name} is a built-in engine")
    CUSTOM[name] = engine


def unregister(name: str) -> None:
    CUSTOM.pop(name, None)


@dataclass
class Detection:
    findings: DataFrame   # schema of engines.detect
    errors: DataFrame     # scan_id (null: the whole run), engine, error


def _finding(name: str, n: int, f: Mapping) -> tuple:
    missing = [k for k in REQUIRED if f.get(k) is None]
    if missing:
        raise ValueError(f"finding without {', '.join(missing)}")
    return (name, n, str(f["type"]), str(f["category"]), str(f["severity"]), float(f["confidence"]), str(f.get("element") or ""), str(f.get("evidence") or ""),
            str(f.get("description") or f["type"]), str(f.get("recommendation") or ""), [str(x) for x in f.get("legal_refs") or []], bool(f.get("is_critical")), None)


def isolated(engines: Mapping[str, Engine], page: dict) -> list[tuple]:
    """Rows of all engines for one page; an engine that raises leaves one error row and nothing else."""
    out = []
    for name, engine in engines.items():
        try:
            rows = [_finding(name, i + 1, f) for i, f in enumerate(engine(page))]
        except Exception as e:  # the point of isolation: whatever the engine raises is its own failure
            rows = [(name, 0, *[None] * 10, f"{type(e).__name__}: {e}")]
        out += rows
    return out


def custom_rows(extracted: DataFrame, engines: Mapping[str, Engine], id_col: str = "page_id") -> DataFrame:
    """Findings and errors of the custom engines: scan_id and the columns of ``_ROW``."""
    engines, names = dict(engines), list(extracted.columns)

    class Pages:
        def eval(self, page):
            yield from isolated(engines, {c: page[c] for c in names})

    run = udtf(Pages, returnType=_ROW)
    pages = extracted.select(F.col(id_col).alias("scan_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_page"))
    return pages.lateralJoin(run(F.col("_page").outer())).drop("_page")


def _sound(extracted: DataFrame, names: list[str], id_col: str) -> tuple[list[str], list[tuple]]:
    """Built-in engines whose expressions can be built and analysed, and the others' errors."""
    good, bad = [], []
    for name in names:
        try:
            E.detect(extracted, [name], id_col).schema
            good.append(name)
        except Exception as e:
            bad.append((None, name, f"{type(e).__name__}: {str(e).splitlines()[0]}"))
    return good, bad


def detect(extracted: DataFrame, engines: Iterable[str] | None = None, custom: Mapping[str, Engine] | None = None, id_col: str = "page_id") -> Detection:
    """Run built-in ``engines`` (all by default) and ``custom`` ones (all registered
    by default).  Custom findings follow the built-in ones of a page, in order of
    registration and emission."""
    custom = CUSTOM if custom is None else custom
    good, bad = _sound(extracted, list(E.ENGINES if engines is None else engines), id_col)
    spark, key = extracted.sparkSession, extracted.schema[id_col].dataType
    errors = spark.createDataFrame(bad, T.StructType([T.StructField("scan_id", key), T.StructField("engine", T.StringType()), T.StructField("error", T.StringType())]))
    if "extract_error" in extracted.columns:
        errors = errors.unionByName(extracted.where("extract_error is not null").select(F.col(id_col).alias("scan_id"), F.lit("extract").alias("engine"), F.col("extract_error").alias("error")))
    findings = E.detect(extracted, good, id_col) if good else None
    if custom:
        rows = materialize(custom_rows(extracted, custom, id_col), "custom-findings")  # findings and errors read it
        order = F.array_position(F.array(*[F.lit(n) for n in custom]), F.col("engine")).cast("bigint")
        seq = order * F.lit(1 << 20) + F.col("n")
        own = rows.where("error is null").select(
            "scan_id", F.lit(fixed.CUSTOM_ENGINE_RANK).alias("erank"), seq.alias("seq"), (F.lit(fixed.CUSTOM_ENGINE_RANK).cast("bigint") * F.lit(1 << 40) + seq).alias("pos"),
            "engine", "type", "category", "severity", "confidence", "element", "evidence", "description", "recommendation", "legal_refs", "is_critical")
        findings = own if findings is None else findings.unionByName(own)
        errors = errors.unionByName(rows.where("error is not null").select("scan_id", "engine", "error"))
    if findings is None:
        places = [T.StructField("scan_id", key), T.StructField("erank", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("pos", T.LongType())]
        findings = spark.createDataFrame([], T.StructType([*places, *[f for f in _ROW if f.name not in ("n", "error")]]))
    return Detection(findings, errors)
