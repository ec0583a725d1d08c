"""Views that read the driver's tables as security inputs (see FIXTURES.md).

Every view is a narrow projection, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowguard.schemas import as_packets
from flowguard.session import estimated_bytes, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table, as Spark estimates them, up to which it is broadcast to a table of texts.
LOOKUP_BYTES = 32 << 20


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str, by_bytes: bool = True) -> DataFrame:
    """Columns of a table of long texts, on enough partitions for the work on them."""
    return spread(table(spark, sf_dir, name).select(*columns), by_bytes)


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def _second(number: Column) -> Column:
    """The number-th second of 2024."""
    return F.timestamp_seconds(F.lit(1704067200) + number)


def packets_from_events(events: DataFrame) -> DataFrame:
    """One packet per event.  Errors become ARP packets, sign-ups UDP, the others TCP."""
    user, kind, number = F.col("user_id"), F.col("event_type"), F.col("event_id")
    src = F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))
    dst = F.concat(F.lit("192.168.1."), (_k() % 3).cast("string"))
    is_arp = kind == "error"
    transport = F.when(kind == "signup", "UDP").when(~is_arp, "TCP")
    highest = (
        F.when(kind == "click", "HTTP").when(kind == "view", "TLS").when(kind == "signup", "DNS")
        .when(kind == "purchase", "FTP").otherwise("ARP")
    )
    ends = F.struct(src.alias("src"), dst.alias("dst"))
    arp_ends = F.struct(src.alias("src_proto_ipv4"), dst.alias("dst_proto_ipv4"))
    return as_packets(
        events.select(
            number.alias("pkt_no"),
            F.concat(F.lit("edge-"), (number % 3).cast("string")).alias("sensor"),
            F.col("ts").cast("timestamp").alias("sniff_ts"),
            (F.col("value") / 100).alias("time_delta"),
            F.when(is_arp, F.array(F.lit("eth"), F.lit("arp")))
            .otherwise(F.array(F.lit("eth"), F.lit("ip"), F.lower(transport), F.lower(highest)))
            .alias("layers"),
            highest.alias("highest_layer"),
            transport.alias("transport_layer"),
            (F.floor("value") + 60).cast("int").alias("length"),
            F.when(~is_arp, ends).alias("ip"),
            F.when(is_arp, arp_ends).alias("arp"),
            (user + 1024).cast("int").alias("src_port"),
            _k().alias("dst_port"),
            F.when(
                transport == "TCP",
                F.struct(
                    (number * 7 % 100000).cast("string").alias("seq"),
                    (number * 3 % 1000).cast("string").alias("ack"),
                    F.lit(0).alias("fin"),
                ),
            ).alias("tcp"),
        )
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def mixed_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with IPv6 packets (numbers divisible by 11) and some that hold no address (by 13)."""
    six, none = F.col("pkt_no") % 11 == 0, F.col("pkt_no") % 13 == 0
    has_ip = F.col("ip").isNotNull()
    return packets(spark, sf_dir).select(
        "*",
        F.when(has_ip & none, F.array(F.lit("eth"), F.lit("llc")))
        .when(has_ip & six, F.transform("layers", lambda n: F.when(n == "ip", "ipv6").otherwise(n)))
        .otherwise(F.col("layers")).alias("_layers"),
        F.when(has_ip & six & ~none, F.struct(
            F.concat(F.lit("fd00::"), F.col("ip.src")).alias("src"),
            F.concat(F.lit("fd00::"), F.col("ip.dst")).alias("dst"),
        )).alias("_six"),
        F.when(~six & ~none, F.col("ip")).alias("_ip"),
    ).drop("layers", "ipv6", "ip").withColumnsRenamed(
        {"_layers": "layers", "_six": "ipv6", "_ip": "ip"}
    )


def http_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTTP packet per page; the page number decides which field carries the text. Every page's html is in one of them."""
    page, url, html = F.col("page_id"), F.col("url"), F.col("html")
    turn = page % 5
    uri = F.when(turn == 0, F.concat(url, F.lit("&q=%3Cb%3Ex%3C/b%3E+1%"), html))
    # a value ends with its line
    form = F.concat(F.lit("Form item:\n  Key: a\n  Value: "), url, F.lit("\n  Key: b\n  Value: x "), F.translate("html", "\n", " "))
    return as_packets(
        texts(spark, sf_dir, "pages", "page_id", "url", "html", by_bytes=False).select(
            page.alias("pkt_no"),
            _second(page).alias("sniff_ts"),
            F.struct(
                F.concat(F.lit("10.1.0."), (page % 256).cast("string")).alias("src"),
                F.lit("192.168.2.1").alias("dst"),
            ).alias("ip"),
            F.when(
                turn < 4,
                F.struct(
                    uri.alias("request_uri"),
                    uri.alias("request_full_uri"),
                    F.when(turn == 1, url).alias("referer"),
                    F.when(turn.isin(1, 2), html).alias("cookie"),
                    F.when(turn == 3, html).alias("user_agent"),
                    F.lit(None).cast("string").alias("data"),
                ),
            ).alias("http"),
            F.when(turn == 4, form).alias("form_text"),
        )
    )


def payload_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per document, hex-encoded, with the ``toxic`` label where there is one.

    Labels of bounded size are broadcast, as the other way to join them is to deal and sort all texts.
    """
    docs = texts(spark, sf_dir, "documents", "doc_id", "text", "lang", by_bytes=False)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    labels = F.broadcast(labels) if estimated_bytes(labels) <= LOOKUP_BYTES else labels
    doc = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        doc.alias("pkt_no"),
        _second(doc).alias("sniff_ts"),
        F.struct(
            F.concat(F.lit("10.2.0."), (doc % 256).cast("string")).alias("src"),
            F.lit("192.168.3.1").alias("dst"),
        ).alias("ip"),
        F.struct(F.hex("text").alias("data")).alias("http"),
        F.when(doc % 7 == 0, F.struct(F.hex(F.concat_ws(" ", F.upper("lang"), "text")).alias("data"))).alias("mime_multipart"),
        "label",
    )


def ftp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per conversation: user turns store a file, assistant turns carry text."""
    talks = table(spark, sf_dir, "conversations")
    ends = talks.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    role, turn = F.col("role"), F.col("turn").cast("string")
    return talks.join(ends, "conv_id").select(
        F.col("conv_id").alias("flow"),
        F.col("turn").alias("seq"),
        _second(F.col("conv_id") * 60 + F.col("turn")).alias("sniff_ts"),
        F.concat(F.lit("10.3.0."), (F.col("conv_id") % 256).cast("string")).alias("src_ip"),
        F.lit("192.168.4.1").alias("dst_ip"),
        F.when(role == "user", "STOR").when(role == "system", "USER").alias("request_command"),
        F.when(role == "user", F.concat(F.lit("f"), turn, F.lit(".TXT")))
        .when(role == "system", "anonymous").alias("request_arg"),
        F.when(role == "assistant", F.col("text")).alias("text_lines"),
        (F.col("turn") == F.col("_last")).cast("int").alias("fin"),
    )


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("event_type") == "error", "[新报警]").otherwise("[info]")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("ip"),
        F.concat(mark, F.col("props")).alias("info"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("datetime"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(
        F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 100).cast("string")).alias("ip"),
        F.col("c_name").alias("asset_name"),
    )


def ids_lines_from_events(events: DataFrame) -> DataFrame:
    """One line of the alert log per event."""
    kind = F.col("event_type")
    msg = (
        F.when(kind == "click", "(x) Port Scan").when(kind == "view", "SQL Inject y")
        .when(kind == "purchase", "XML Inject").otherwise("ICMP ping")
    )
    number = F.col("event_id").cast("string")
    return events.select(
        F.col("event_id").alias("line_no"),
        F.concat(
            F.lit('{"msg":"'), msg, F.lit('","timestamp":"'), number,
            F.lit('","src_ap":"10.0.0.1:'), F.col("user_id").cast("string"),
            F.lit('","dst_ap":"192.168.1.1:80"}'),
        ).alias("line"),
    )


def ids_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_lines_from_events(table(spark, sf_dir, "events"))


def ftp_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FTP flows as full packets: commands on an ``ftp`` layer, text on ``ftp-data``."""
    rows = ftp_packets(spark, sf_dir)
    is_data = F.col("text_lines").isNotNull()
    layer = F.when(is_data, "ftp-data").otherwise("ftp")
    return as_packets(
        rows.select(
            (F.col("flow") * 1000 + F.col("seq")).alias("pkt_no"),
            F.lit("edge-0").alias("sensor"),
            "sniff_ts",
            F.array(F.lit("eth"), F.lit("ip"), F.lit("tcp"), layer).alias("layers"),
            F.when(is_data, "DATA-TEXT-LINES").otherwise("FTP").alias("highest_layer"),
            F.lit("TCP").alias("transport_layer"),
            F.struct(
                F.concat(
                    F.lit("10.3."), F.expr("string(flow div 256)"), F.lit("."), F.expr("string(flow % 256)")
                ).alias("src"),
                F.lit("192.168.4.1").alias("dst"),
            ).alias("ip"),
            # text has connections of its own, one for each packet's number
            F.when(is_data, F.col("seq") % 1000 + 2000).otherwise(1024).cast("int").alias("src_port"),
            F.when(is_data, 20).otherwise(21).alias("dst_port"),
            F.struct(F.lit("1").alias("seq"), F.lit("1").alias("ack"), "fin").alias("tcp"),
            F.when(~is_data, F.struct("request_command", "request_arg")).alias("ftp"),
            "text_lines",
        )
    )


# Section names of the made-up ELF files, each at a known offset of the name table.
_NAMES = {".text": 1, ".data": 7, ".debug_info": 13, ".ARM.exidx": 25, ".shstrtab": 36}
_NAME_TABLE = "\0" + "".join(n + "\0" for n in _NAMES)


def elf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ELF file per document, its text in ``.text``; the number decides class, byte order and layout.

    Numbers ending in 9 stay plain text, and those divisible by 20 are cut in half.
    """
    doc = F.col("doc_id")
    is64 = doc % 2 == 0

    def put(value: str | int, size: int) -> str:
        """SQL: hex digits of a number of ``size`` bytes in the file's byte order."""
        if isinstance(value, int):
            both = [value.to_bytes(size, order).hex().upper() for order in ("little", "big")]
            return f"if(doc_id div 2 % 2 = 0, '{both[0]}', '{both[1]}')"
        digits = f"lpad(hex(bigint({value})), {2 * size}, '0')"
        turned = ", ".join(f"substring({digits}, {2 * i + 1}, 2)" for i in reversed(range(size)))
        return f"if(doc_id div 2 % 2 = 0, concat({turned}), {digits})"

    def word(value: str | int) -> str:
        return f"if(doc_id % 2 = 0, {put(value, 8)}, {put(value, 4)})"

    def joined(*parts: str) -> str:
        return f"concat({', '.join(parts)})"

    sizes = texts(spark, sf_dir, "documents", "doc_id", "text", by_bytes=False).select(
        "doc_id", "text",
        (doc % 4).alias("n_seg"),
        F.when(doc % 4 == 0, 3).when(doc % 4 == 1, 62).when(doc % 4 == 2, 40).otherwise(8).alias("machine"),
        F.octet_length("text").alias("text_size"),
        F.when(is64, 64).otherwise(52).alias("head_size"),
        F.when(is64, 56).otherwise(32).alias("ph_size"),
        F.when(is64, 64).otherwise(40).alias("sh_size"),
        (doc % 3 != 0).alias("has_data"), (doc % 4 == 1).alias("has_debug"), (doc % 4 == 2).alias("has_exidx"),
    )
    placed = (
        sizes.withColumn("text_at", F.expr("head_size + n_seg * ph_size"))
        .withColumn("names_at", F.expr("text_at + text_size"))
        .withColumn("sh_at", F.expr(f"names_at + {len(_NAME_TABLE)}"))
        .withColumn("n_sec", F.expr("3 + int(has_data) + int(has_debug) + int(has_exidx)"))
    )
    head = joined(
        "'7F454C46'", "if(doc_id % 2 = 0, '02', '01')", "if(doc_id div 2 % 2 = 0, '01', '02')", "'01'",
        "if(doc_id % 3 = 0, '03', '00')", f"'{'00' * 8}'",
        put("doc_id % 3 + 1", 2), put("machine", 2), put(1, 4), word("doc_id + 4096"), word("head_size"),
        word("sh_at"), put(0, 4), put("head_size", 2), put("ph_size", 2), put("n_seg", 2),
        put("sh_size", 2), put("n_sec", 2), put("n_sec - 1", 2),
    )

    def segment(kind: str | int, flags: int) -> str:
        wide = [put(kind, 4), put(flags, 4), put("text_at", 8), put("doc_id", 8), put("doc_id + 1", 8),
                put("text_size", 8), put("text_size + 5", 8), put(4096, 8)]
        narrow = [put(kind, 4), put("text_at", 4), put("doc_id", 4), put("doc_id + 1", 4), put("text_size", 4),
                  put("text_size + 5", 4), put(flags, 4), put(4096, 4)]
        return f"if(doc_id % 2 = 0, {joined(*wide)}, {joined(*narrow)})"

    segments = [
        segment(1, 5),
        segment("if(doc_id % 3 = 0, 3, 1)", 6),
        segment(f"if(doc_id % 5 = 0, 2, {0x6474E551})", 7),
    ]

    def section(name: int, kind: int, flags: int, addr, at, size, align: int) -> str:
        return joined(
            put(name, 4), put(kind, 4), word(flags), word(addr), word(at), word(size), put(0, 4), put(0, 4),
            word(align), word(0),
        )

    def only_if(flag: str, part: str) -> str:
        return f"if({flag}, {part}, '')"

    shdrs = joined(
        section(0, 0, 0, 0, 0, 0, 0),
        section(_NAMES[".text"], 1, 6, "doc_id + 4096", "text_at", "text_size", 16),
        only_if("has_data", section(_NAMES[".data"], 1, 3, 8192, "names_at", 0, 8)),
        only_if("has_debug", section(_NAMES[".debug_info"], 1, 0, 0, "text_at", "text_size", 1)),
        only_if("has_exidx", section(_NAMES[".ARM.exidx"], 0x70000001, 2, 0, "text_at", 0, 4)),
        section(_NAMES[".shstrtab"], 3, 0, 0, "names_at", len(_NAME_TABLE), 1),
    )
    phdrs = joined(*[only_if(f"n_seg > {i}", s) for i, s in enumerate(segments)])
    names = _NAME_TABLE.encode().hex().upper()
    whole = F.expr(f"unhex({joined(head, phdrs, 'hex(text)', repr(names), shdrs)})")
    content = (
        F.when(doc % 10 == 9, F.col("text").cast("binary"))
        .when(doc % 20 == 0, F.substring(whole, F.lit(1), F.expr("int(text_size / 2) + 20")))
        .otherwise(whole)
    )
    return placed.select(
        "doc_id", F.concat(F.lit("doc"), doc.cast("string"), F.lit(".bin")).alias("file_name"),
        content.alias("content"),
    )
