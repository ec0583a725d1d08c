"""Cross-site-scripting detection in HTTP fields and form values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions import text as tx
from flowguard.functions.once import once
from flowguard.operators.events import packet_event, packet_key
from flowguard.operators.scoring import Scorer
from flowguard.schemas import XSS


def field_texts(mode: str = "first") -> Column:
    """Array of ``(field, text)`` to be judged for a packet.

    ``first`` judges only the first present of URI, referer, cookie and user agent, and the form
    values when there is none of them; ``any`` judges all that are there.
    """
    uri, referer = F.col("http.request_uri"), F.col("http.referer")
    cookie, agent = F.col("http.cookie"), F.col("http.user_agent")
    header = [
        ("uri", uri, tx.extract_tag(tx.url_unquote(uri))),
        ("referer", referer, tx.extract_tag(tx.url_unquote(referer))),
        ("cookie", cookie, tx.extract_tag(cookie)),
        ("user-agent", agent, tx.extract_tag(agent)),
    ]

    def item(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), text.alias("text"))

    def present(name: str, source: Column, text: Column) -> Column:
        return F.when(source.isNotNull(), F.array(item(name, text)))

    form = F.transform(tx.form_values(F.col("form_text")), lambda v: item("form", v))
    if mode == "any":
        none = F.filter(F.array(item("", F.lit(""))), lambda _: F.lit(False))
        return F.concat(*[F.coalesce(a, none) for a in [*(present(*h) for h in header), form]])
    if mode == "first":
        return F.coalesce(*[present(*h) for h in header], form)
    raise ValueError(f"unknown mode {mode!r}")


def texts(packets: DataFrame, mode: str = "first") -> DataFrame:
    """One row per packet and judged text."""
    return packets.select("*", F.inline(field_texts(mode)))


def frames(judged: DataFrame) -> DataFrame:
    """One row per 100 x 100 frame of character codes.

    A text of up to 10 000 codes is one frame; a longer one continues in further frames, so the
    whole of it is judged.
    """
    coded = once(judged, _codes=tx.code_text(F.col("text")))
    return coded.select(*judged.columns, F.posexplode(tx.frames(F.col("_codes"))).alias("frame_no", "frame"))


def with_vector(framed: DataFrame) -> DataFrame:
    """Add the frame as a sparse MLlib vector, for trained scorers."""
    return framed.withColumn("x", tx.frame_sparse(F.col("frame")))


def events(
    packets: DataFrame, scorer: Scorer, mode: str = "first", detail: list[str] | None = None
) -> DataFrame:
    """A packet is an event as soon as one frame of one of its texts is judged hostile.

    The verdicts are folded per packet before anything is joined back to the packets.
    """
    keyed = packets.withColumn("_key", packet_key(packets))
    scored = scorer(frames(texts(keyed.select("_key", "http", "form_text"), mode)))
    hits = scored.where("prediction = 1").select("_key").distinct()
    return packet_event(keyed.join(hits, "_key", "left_semi"), XSS, detail or packets.columns)
