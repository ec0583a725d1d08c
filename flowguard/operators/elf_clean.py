"""From raw ELF features to model inputs and file events: one pipeline for all three file detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions.encode import dense_code, truthy, value_map
from flowguard.operators import elf
from flowguard.operators.elf_columns import (
    CODED, FEATURES, FILL, FLAGS, MODEL_INPUTS, TEXTS, VALUE_MAPS,
)
from flowguard.operators.events import detected
from flowguard.operators.scoring import Scorer
from flowguard.schemas import TROJAN, VIRUS, WORM


def conform(df: DataFrame, features: str) -> DataFrame:
    """Project a map of feature names to texts onto the fixed columns.

    Absent features become null, unknown ones are dropped, and text that is no number becomes null.
    """
    return df.selectExpr(
        *[f"try_cast(try_element_at({features}, '{f.name}') AS {f.dataType.simpleString()}) AS {f.name}" for f in FEATURES]
    )


def fill_nulls(df: DataFrame, values: dict[str, int] = FILL) -> DataFrame:
    """Fill missing values column by column; text columns get the number as text."""
    return df.na.fill({c: str(v) if c in TEXTS else v for c, v in values.items()})


def map_values(df: DataFrame, maps: dict[str, dict] = VALUE_MAPS) -> DataFrame:
    """Replace known names by numbers; a value that is in no map stays."""
    return df.withColumns({c: value_map(c, m) for c, m in maps.items()})


def clean(features: DataFrame, scan: str = "label") -> DataFrame:
    """Numbers for flags, ranks for categories (within the scan), fills, replacements, no copies.

    ``features`` is read twice, so pass a table rather than a parse of the files.
    """
    flags = features.withColumns({c: F.col(c).cast("int") for c in FLAGS})
    filled = fill_nulls(dense_code(flags, CODED, scan))
    return map_values(filled).withColumn("ehabi_infos", truthy(F.col("ehabi_infos"))).dropDuplicates()


def model_inputs(cleaned: DataFrame, *keys: str) -> DataFrame:
    """The 62 model inputs as doubles, after the given key columns; -1 where a value is missing."""
    numbers = [f"coalesce(try_cast({c} AS double), -1D) AS {c}" for c in MODEL_INPUTS]
    return cleaned.selectExpr(*keys, *numbers)


def score(cleaned: DataFrame, scorer: Scorer, *keys: str) -> DataFrame:
    """Verdict per file."""
    return scorer(model_inputs(cleaned, *keys)).select(*keys, "prediction")


def verdicts(files: DataFrame, scorer: Scorer, scan: Column, table=lambda df: df) -> DataFrame:
    """Verdict of each file (``file_name``, ``content``): 1 hostile, 0 harmless or no ELF file.

    ``table`` may write the parsed features out and read them back, so that files are parsed once.
    """
    features = table(elf.features(elf.parse(files), F.col("file_name"), scan))
    scored = score(clean(features), scorer, "file_name")
    known = scored.groupBy("file_name").agg(F.max("prediction").alias("prediction"))
    return files.select("file_name").join(known, "file_name", "left").withColumn(
        "prediction", F.coalesce("prediction", F.lit(0))
    )


def file_events(
    transfers: DataFrame, judged: dict[int, DataFrame], key: str, force: tuple[int, ...] = ()
) -> DataFrame:
    """Trojan, worm and virus events of the closed transfers.

    ``judged`` maps an event type to its verdicts (``key``, ``prediction``).  Types in ``force``
    alarm on every closed transfer whatever the verdict; a transfer without content (too large to be
    put together) alarms for all types, as nothing cleared it.  The transfers are read once; detectors
    that share a table of verdicts share its join.
    """
    unknown = set(judged) - {TROJAN, WORM, VIRUS}
    if unknown:
        raise ValueError(f"not a file event type: {sorted(unknown)}")
    closed = transfers.where("closed")
    flags: dict[int, Column] = {}
    joined: dict[int, Column] = {}
    for kind, verdict in judged.items():
        if kind in force:
            flags[kind] = F.lit(True)
            continue
        if id(verdict) not in joined:
            bad = f"_bad{kind}"
            hostile = verdict.where("prediction = 1").select(key).distinct().withColumn(bad, F.lit(True))
            closed = closed.join(hostile, key, "left")
            joined[id(verdict)] = F.col(bad)
        flags[kind] = joined[id(verdict)]
    unread = F.col("content").isNull() if "content" in transfers.columns else F.lit(False)
    kinds = F.filter(F.array(*[F.when(f | unread, F.lit(k)) for k, f in flags.items()]), lambda k: k.isNotNull())
    time = F.col("time") if "time" in transfers.columns else F.lit(None)
    return closed.select("*", F.explode(kinds).alias("type")).select(
        "type",
        time.cast("timestamp").alias("time"),
        detected(),
        "src_ip",
        "dst_ip",
        F.to_json(F.struct("flow", "sess", "file_name", "size")).alias("detail"),
    )
