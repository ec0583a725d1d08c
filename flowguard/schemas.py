"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ENDPOINTS = _struct(src=_S, dst=_S)

PACKET = _struct(
    pkt_no=_L,
    sensor=_S,
    sniff_ts=T.TimestampType(),
    time_delta=_D,
    layers=T.ArrayType(_S),
    highest_layer=_S,
    transport_layer=_S,
    length=_I,
    ip=ENDPOINTS,
    ipv6=ENDPOINTS,
    arp=_struct(src_proto_ipv4=_S, dst_proto_ipv4=_S),
    src_port=_I,
    dst_port=_I,
    tcp=_struct(seq=_S, ack=_S, fin=_I),
    http=_struct(request_uri=_S, request_full_uri=_S, referer=_S, cookie=_S, user_agent=_S, data=_S),
    mime_multipart=_struct(data=_S),
    form_text=_S,
    ftp=_struct(request_command=_S, request_arg=_S),
    text_lines=_S,
)

ALARM = _struct(seq=_L, ip=_S, info=_S, datetime=T.TimestampType())
ASSET = _struct(ip=_S, asset_name=_S)
IDS_ALERT = _struct(msg=_S, timestamp=_S, src_ap=_S, dst_ap=_S)

# ``time`` is when it happened, ``detected_at`` when a detector said so (in a stream, the time of the micro-batch)
TRAFFIC_EVENT = _struct(
    type=_I, time=T.TimestampType(), detected_at=T.TimestampType(), src_ip=_S, dst_ip=_S, detail=_S
)
ASSET_NAMES = T.ArrayType(_struct(asset_name=_S, copies=_L))
HOST_EVENT = _struct(
    ip=_S, names=ASSET_NAMES, n_names=_L, detail=_S, time=T.TimestampType(), detected_at=T.TimestampType(),
    run=_L, part=_L,
)
ENVELOPE = _struct(type=_I, traffic=TRAFFIC_EVENT, host=HOST_EVENT)

# Kind of envelope, and kind of traffic event.
MSG_TRAFFIC, MSG_HOST, MSG_USER = 0, 1, 2
DDOS, WEBSHELL, BOTNET, TROJAN, WORM, VIRUS, SQL_INJECT, XML_INJECT, XSS, PORT_SCAN = range(10)


def as_packets(df: DataFrame) -> DataFrame:
    """Give ``df`` every packet column: present ones are cast, absent ones are null.

    Layers may have some of their fields only.  Extra columns are dropped, so a detector reads the
    same row type from any source.
    """
    types = {f.name: f.dataType for f in df.schema}

    def column(name: str, wanted: T.DataType, path: str, found: T.DataType | None) -> Column:
        if found is None:
            return F.lit(None).cast(wanted).alias(name)
        if not isinstance(wanted, T.StructType) or found == wanted:
            return F.col(path).cast(wanted).alias(name)
        inner = {f.name: f.dataType for f in found}
        layer = F.struct(*[column(f.name, f.dataType, f"{path}.{f.name}", inner.get(f.name)) for f in wanted])
        return F.when(F.col(path).isNotNull(), layer).alias(name)

    return df.select(*[column(f.name, f.dataType, f.name, types.get(f.name)) for f in PACKET])
