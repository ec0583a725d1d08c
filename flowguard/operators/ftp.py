"""Files carried over FTP: which file a packet belongs to, and the file's content.

Commands travel on one connection and the text of the files on others, so a ``flow`` is a pair of
hosts, whatever their ports. Rows also need ``seq`` (order within the flow), ``request_command``,
``request_arg``, ``text_lines`` and ``fin``; endpoints ``src_ip``/``dst_ip`` are optional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions.network import layer_at
from flowguard.functions.text import trim_ftp_text
from flowguard.operators.ordered import Last, Sum, Total, scan

MAX_FILE_BYTES = 1 << 30  # a larger file does not fit one row; it has no content here, and alarms unread


def command_file() -> Column:
    """The file named by a RETR or STOR command, else null."""
    return F.when(F.col("request_command").isin("RETR", "STOR"), F.col("request_arg"))


def is_data() -> Column:
    """Packets that carry a piece of a text file."""
    return (layer_at(4) == "ftp-data") & (F.col("highest_layer") == "DATA-TEXT-LINES")


def from_packets(packets: DataFrame) -> DataFrame:
    """FTP rows of a packet table; a flow is an unordered pair of hosts."""
    ends = F.array_sort(F.array("ip.src", "ip.dst"))
    is_command = layer_at(4) == "ftp"
    return packets.where((layer_at(3) == "tcp") & F.col("ip").isNotNull()).select(
        F.array_join(ends, "-").alias("flow"),
        F.col("pkt_no").alias("seq"),
        "sniff_ts",
        F.col("ip.src").alias("src_ip"),
        F.col("ip.dst").alias("dst_ip"),
        F.when(is_command, F.col("ftp.request_command")).alias("request_command"),
        F.when(is_command, F.col("ftp.request_arg")).alias("request_arg"),
        F.when(is_data(), F.col("text_lines")).alias("text_lines"),
        F.coalesce("tcp.fin", F.lit(0)).alias("fin"),
    )


def since_last(rows: DataFrame) -> DataFrame:
    """Add ``_seen``, the time of the flow's row before."""
    return scan(rows, ["flow"], "seq", _seen=Last(F.col("sniff_ts"), before=True))


def sessions(rows: DataFrame, idle_seconds: int | None = None) -> DataFrame:
    """Add ``sess`` (FINs of the flow so far), ``file_name`` and ``file_no`` (name and place of the command
    that opened the file) and ``closed`` (a FIN, or silence, comes yet).

    A command opens a file; the next command or a FIN of either connection ends it.  One ordered scan
    carries both the latest command and the latest FIN, and whichever is later decides.  With
    ``idle_seconds`` a flow that was silent for longer (by ``sniff_ts``) ends its file as well: what comes
    after the silence belongs to no file until the next command.
    """
    ends = [c for c in ("src_ip", "dst_ip") if c in rows.columns]
    named = command_file()
    silence: dict[str, Last | Sum | Total] = {}
    columns = [c for c in rows.columns if c != "_seen"]
    if idle_seconds is not None:
        rows = rows if "_seen" in rows.columns else since_last(rows)
        gap = F.unix_micros("sniff_ts") - F.unix_micros("_seen") > idle_seconds * 1_000_000
        n = F.coalesce(gap, F.lit(False)).cast("long")
        silence = {"_gap": Last(F.when(gap, F.struct("seq"))), "_gaps": Sum(n), "_all_gaps": Total(n)}
    carried = scan(
        rows, ["flow"], "seq",
        sess=Sum(F.col("fin").cast("long"), before=True),
        _fins=Total(F.col("fin").cast("long")),
        _cmd=Last(F.when(named.isNotNull(), F.struct("seq", named.alias("file"), *ends))),
        _fin=Last(F.when(F.col("fin") == 1, F.struct("seq")), before=True),
        **silence,
    )
    is_open = F.col("_fin").isNull() | (F.col("_cmd.seq") > F.col("_fin.seq"))
    closed = F.col("sess") < F.col("_fins")
    if silence:
        is_open &= F.col("_gap").isNull() | (F.col("_cmd.seq") >= F.col("_gap.seq"))
        closed |= F.col("_gaps") < F.col("_all_gaps")
    return carried.select(
        *[c for c in columns if c not in ends],
        "sess",
        F.when(is_open, F.col("_cmd.file")).alias("file_name"),
        F.when(is_open, F.col("_cmd.seq")).alias("file_no"),
        closed.alias("closed"),
        *[F.when(is_open, F.col(f"_cmd.{c}")).alias(c) for c in ends],
    )


def files(with_sessions: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One row per command that named a file: the file's pieces, cleaned and joined in order.

    A second scan gives each piece its byte offset in the file.  Pieces from ``max_bytes`` on are
    counted but not gathered, so one giant file cannot fill a task; its ``content`` is null and
    ``size`` tells the whole size.
    """
    pieces = with_sessions.where("file_name IS NOT NULL").withColumn(
        "piece", F.coalesce(trim_ftp_text(F.col("text_lines"), F.col("file_name")), F.lit(""))
    )
    size = F.octet_length("piece").cast("long")
    ends = [c for c in ("src_ip", "dst_ip") if c in pieces.columns]
    time = ["sniff_ts"] if "sniff_ts" in pieces.columns else []
    placed = scan(
        pieces.select("flow", "sess", "file_no", "seq", "file_name", "closed", "piece", *ends, *time),
        ["flow", "sess", "file_no"], "seq", _offset=Sum(size, before=True),
    )
    kept = F.when(F.col("_offset") + size <= max_bytes, F.col("piece"))
    return (
        placed.withColumn("_kept", kept)
        .groupBy("flow", "sess", "file_no")
        .agg(
            F.max_by("file_name", "seq").alias("file_name"),
            *[F.max_by(c, "seq").alias(c) for c in ends],
            *[F.max(c).alias("time") for c in time],
            F.max("closed").alias("closed"),
            F.sum(size).alias("size"),
            F.expr("listagg(_kept, '') WITHIN GROUP (ORDER BY seq)").alias("content"),
        )
        .withColumn("content", F.when(F.col("size") <= max_bytes, F.coalesce("content", F.lit(""))))
    )
