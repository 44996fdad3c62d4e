"""Control messages of variable length: group records, reservations, VLAN registrations, link options, service names.

Each message is walked by one `aggregate` over a bounded sequence that only finds offsets; the fields are then read by
plain expressions. Group records are read from all messages of an Arrow batch at once. One message stays one row until its
entries are exploded, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.functions.binary import cut, eui, hex_at, stream_id_text, uint

_NONE = -1  # offset of a finished walk


def _long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("bigint")


def _walk(rounds: Column, state: dict[str, Column], step: Callable[[Column], dict[str, Column]]) -> Column:
    """Fold `step` over at most `rounds` rounds; a state whose `at` is _NONE no longer changes."""
    start = F.struct(*[v.alias(n) for n, v in state.items()])
    turns = F.when(rounds > 0, F.sequence(F.lit(1), rounds.cast("int"))).otherwise(F.array().cast("array<int>"))

    def fold(acc: Column, _: Column) -> Column:
        new = F.struct(*[v.alias(n) for n, v in step(acc).items()])
        return F.when(acc["at"] == _NONE, acc).otherwise(new)

    return F.aggregate(turns, start, fold)


def _group_texts(payloads: pa.Array) -> pa.Array:
    """The groups named in each report. All reports of a batch take a step at once: their next record is read."""
    body = [p or b"" for p in payloads.to_pylist()]
    data = np.frombuffer(b"".join(body), np.uint8)
    size = np.fromiter(map(len, body), np.int64, len(body))
    first = np.cumsum(size) - size

    def number(at: np.ndarray, n: int) -> np.ndarray:
        return sum((data[at + i].astype(np.int64) << 8 * (n - 1 - i) for i in range(n)), np.zeros(len(at), np.int64))

    left = np.zeros(len(body), np.int64)
    headed = np.flatnonzero(size >= 8)
    left[headed] = number(first[headed] + 6, 2)
    rows, at = headed, np.full(len(headed), 8)
    named, groups = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        more = (left[rows] > 0) & (at + 8 <= size[rows])
        rows, at = rows[more], at[more]
        if not len(rows):
            break
        left[rows] -= 1
        group = number(first[rows] + at + 4, 4)
        multicast = (group >= 224 << 24) & (group < 240 << 24)
        named.append(rows[multicast])
        groups.append(group[multicast])
        at = at + 8 + number(first[rows] + at + 2, 2) * 4 + number(first[rows] + at + 1, 1) * 4
    named, groups = np.concatenate(named), np.concatenate(groups)
    groups = groups[np.argsort(named, kind="stable")]
    octets = [pa.array(groups >> s & 255).cast(pa.string()) for s in (24, 16, 8, 0)]
    ends = np.concatenate([[0], np.cumsum(np.bincount(named, minlength=len(body)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.binary_join_element_wise(*octets, "."))


def igmp_v3_groups(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `groups`, the multicast groups named in a version 3 report (empty for reports cut short)."""

    @F.arrow_udf("array<string>")
    def groups(payloads: pa.Array) -> pa.Array:
        return _group_texts(payloads)

    return df.withColumn("groups", groups(F.col(payload)))


# Declaration kinds of the reservation protocol and the bytes their value needs.
DECLARATIONS = [(1, "talker_advertise", 25), (2, "talker_failed", 34), (3, "listener", 9)]

DECLARATION_FIELDS = [
    "decl_type", "stream_id", "dest_mac", "vlan_id", "max_frame_size", "max_interval_frames", "priority", "failure_code",
    "listener_state",
]


def msrp_declarations(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per stream reservation declaration; other attributes are skipped."""
    p = F.col(payload)
    size = F.length(p)

    def attribute(acc: Column) -> dict[str, Column]:
        at = acc["at"]
        kind, n, step = uint(p, at), uint(p, at + 1), uint(p, at + 2, 2)
        whole = (kind != 0) & (at + 4 <= size) & (at + 6 + n <= size)
        wanted = F.lit(False)
        for code, _, need in DECLARATIONS:
            wanted = wanted | ((kind == code) & (n >= need))
        entry = F.struct(kind.alias("kind"), _long(at + 6).alias("value"))
        more = whole & (step > 0) & (at + 4 + step < size)
        return {
            "at": F.when(more, _long(at + 4 + step)).otherwise(_long(_NONE)),
            "found": F.when(whole & wanted, F.array_append(acc["found"], entry)).otherwise(acc["found"]),
        }

    empty = F.array().cast("array<struct<kind:bigint,value:bigint>>")
    start = F.when(uint(p, 0) == 0, _long(1)).otherwise(_long(_NONE))
    walked = _walk(F.ceil(size / 4), {"at": start, "found": empty}, attribute)
    rows = df.select(*df.columns, F.posexplode(walked["found"]).alias("decl_no", "_d"))
    at, kind = F.col("_d.value"), F.col("_d.kind")
    talker = kind < 3
    name = None
    for code, text, _ in DECLARATIONS:
        name = F.when(kind == code, text) if name is None else name.when(kind == code, text)
    return rows.withColumns(
        {
            "decl_type": name,
            "stream_id": stream_id_text(p, at),
            "dest_mac": F.when(talker, eui(p, at + 8, 6)),
            "vlan_id": F.when(talker, uint(p, at + 14, 2).bitwiseAND(0x0FFF)).cast("int"),
            "max_frame_size": F.when(talker, uint(p, at + 16, 2)).cast("int"),
            "max_interval_frames": F.when(talker, uint(p, at + 18, 2)).cast("int"),
            "priority": F.when(talker, F.shiftright(uint(p, at + 20), 5)).cast("int"),
            "failure_code": F.when(kind == 2, uint(p, at + 33)).cast("int"),
            "listener_state": F.when(kind == 3, uint(p, at + 8)).cast("int"),
        }
    ).drop("_d")


def mvrp_vlans(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per VLAN that a registration message names."""
    p = F.col(payload)
    size = F.length(p)

    def part(acc: Column) -> dict[str, Column]:
        at, kind, n = acc["at"], acc["kind"], acc["n"]
        # Between attributes: type and length of the next one. Inside: a vector header, then value and events.
        outside = kind == 0
        begins = (uint(p, at) != 0) & (uint(p, at + 1) > 0)
        head = uint(p, at, 2)
        count = head.bitwiseAND(0x1FFF)
        has_value = (count > 0) & (at + 2 + n <= size)
        after = at + 2 + n + F.ceil(count / 3)
        base = uint(p, at + 2, 2).bitwiseAND(0x0FFF)
        entry = F.struct(base.alias("base"), _long(count).alias("count"))
        at_next = (
            F.when(outside, F.when(begins, at + 2))
            .when(head == 0, at + 2)
            .when(count == 0, at + 2)
            .when(has_value & (after <= size), after)
        )
        take = ~outside & has_value & (kind == 1) & (n == 2)
        return {
            "at": _long(F.coalesce(at_next, F.lit(_NONE))),
            "kind": _long(F.coalesce(F.when(outside, uint(p, at)).when(head == 0, 0).otherwise(kind), F.lit(0))),
            "n": _long(F.coalesce(F.when(outside, uint(p, at + 1)).otherwise(n), F.lit(0))),
            "found": F.when(F.coalesce(take, F.lit(False)), F.array_append(acc["found"], entry)).otherwise(acc["found"]),
        }

    empty = F.array().cast("array<struct<base:bigint,count:bigint>>")
    start = F.when(uint(p, 0) == 0, _long(1)).otherwise(_long(_NONE))
    state = {"at": start, "kind": _long(0), "n": _long(0), "found": empty}
    walked = _walk(F.ceil(size / 2), state, part)
    each = F.flatten(
        F.transform(walked["found"], lambda v: F.transform(F.sequence(v["base"], v["base"] + v["count"] - 1), lambda x: x.bitwiseAND(0x0FFF)))
    )
    vlans = F.filter(F.array_distinct(each), lambda x: x > 0)
    return df.select(*df.columns, F.explode(vlans).alias("vlan_id")).withColumn("vlan_id", F.col("vlan_id").cast("int"))


def _readable(data: Column) -> Column:
    """Printable ASCII as trimmed text, anything else as colon hex."""
    text = F.try_validate_utf8(data.cast("string"))
    pairs = F.regexp_replace(F.lower(F.hex(data)), "(..)(?!$)", "$1:")
    return F.when(F.coalesce(text.rlike(r"^[\x20-\x7e]*$"), F.lit(False)), F.trim(text)).otherwise(pairs)


def lldp_eee(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows whose link announcement carries an active energy-saving option, with port and wake-up times."""
    p = F.col(payload)
    size = F.length(p)

    def option(acc: Column) -> dict[str, Column]:
        at = acc["at"]
        head = uint(p, at, 2)
        kind, n = F.shiftright(head, 9), head.bitwiseAND(0x1FF)
        whole = F.coalesce((kind > 0) & (at + 2 + n <= size), F.lit(False))
        entry = F.struct(_long(kind).alias("kind"), _long(at + 2).alias("value"), _long(n).alias("n"))
        return {
            "at": F.when(whole, _long(at + 2 + n)).otherwise(_long(_NONE)),
            "found": F.when(whole, F.array_append(acc["found"], entry)).otherwise(acc["found"]),
        }

    empty = F.array().cast("array<struct<kind:bigint,value:bigint,n:bigint>>")
    walked = _walk(F.ceil(size / 2), {"at": _long(0), "found": empty}, option)
    df = df.withColumn("_o", walked["found"])

    def last(cond: Callable[[Column], Column]) -> Column:
        return F.try_element_at(F.filter("_o", cond), F.lit(-1))

    # Organisation code 00-12-0F with subtype 5 is the energy-saving option.
    eee = last(lambda o: (o["kind"] == 127) & (o["n"] >= 14) & (hex_at(p, o["value"], 4) == "00120f05"))
    chassis = last(lambda o: (o["kind"] == 1) & (o["n"] >= 2))
    port = last(lambda o: (o["kind"] == 2) & (o["n"] >= 2))

    def ident(o: Column) -> Column:
        return F.coalesce(_readable(cut(p, o["value"] + 1, o["n"] - 1)), F.lit(""))

    df = df.withColumns({"_e": eee["value"], "chassis_id": ident(chassis), "port_id": ident(port)})
    df = df.withColumns(
        {
            "tx_wake_us": uint(p, F.col("_e") + 4, 2).cast("int"),
            "rx_wake_us": uint(p, F.col("_e") + 6, 2).cast("int"),
        }
    )
    return df.where((F.col("tx_wake_us") > 0) | (F.col("rx_wake_us") > 0)).drop("_o", "_e")


def _printable(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[\x20-\x7e]+$"), F.lit(False))


def _label_before(text: Column, service: str) -> Column:
    """The printable DNS label that ends where the first occurrence of a service label starts."""
    start = F.locate(chr(len(service)) + service, text)

    def label(n: Column) -> Column:
        return F.trim(F.substring(text, start - n, n))

    fits = F.filter(
        F.sequence(F.lit(63), F.lit(1), F.lit(-1)),
        lambda n: (start > n + 1) & (F.ascii(F.substring(text, start - n - 1, F.lit(1))) == n) & _printable(label(n)),
    )
    return F.when(F.size(fits) > 0, label(F.get(fits, F.lit(0))))


def _pointer_label(p: Column) -> Column:
    """First label of the first pointer record of a DNS response that has a printable one."""
    size = F.length(p)

    def part(acc: Column) -> dict[str, Column]:
        at, ask, left, in_name = acc["at"], acc["ask"], acc["left"], acc["in_name"]
        b = uint(p, at)
        # One round reads one label of a name, or what follows a complete name.
        ends = (b == 0) | (b >= 0xC0)
        next_label = F.when(b == 0, at + 1).when(b >= 0xC0, at + 2).when(b < 0x40, at + 1 + b)
        kind, n = uint(p, at, 2), uint(p, at + 8, 2)
        length = uint(p, at + 10)
        text = F.trim(F.decode(cut(p, at + 11, length), "ISO-8859-1"))
        hit = ~in_name & (ask == 0) & (kind == 12) & length.between(1, 63) & (at + 11 + length <= size) & _printable(text)
        more = F.when(ask > 0, (ask + left) > 1).otherwise(left > 1)
        after = F.when(ask > 0, at + 4).when(n.isNotNull(), at + 10 + n)
        at_next = F.when(in_name, next_label).when(F.coalesce(hit, F.lit(False)) | ~more, _NONE).otherwise(after)
        return {
            "at": _long(F.coalesce(F.when(at_next < size, at_next), F.lit(_NONE))),
            "ask": _long(F.when(~in_name & (ask > 0), ask - 1).otherwise(ask)),
            "left": _long(F.when(~in_name & (ask == 0), left - 1).otherwise(left)),
            "in_name": F.when(in_name, ~F.coalesce(ends, F.lit(True))).otherwise(F.lit(True)),
            "name": F.when(F.coalesce(hit, F.lit(False)), text).otherwise(acc["name"]),
        }

    ask, left = F.coalesce(uint(p, 4, 2), F.lit(0)), F.coalesce(uint(p, 6, 2), F.lit(0))
    start = F.when((size >= 12) & (ask + left > 0), _long(12)).otherwise(_long(_NONE))
    state = {"at": start, "ask": _long(ask), "left": _long(left), "in_name": F.lit(True), "name": F.lit(None).cast("string")}
    return _walk(size, state, part)["name"]


def service_name(df: DataFrame, services: list[str], payload: str = "payload", name: str = "name") -> DataFrame:
    """Add the device name of a discovery response: the label before one of the service labels, tried in order, else
    the first label a pointer record leads to."""
    text = F.decode(F.col(payload), "ISO-8859-1")
    found = F.coalesce(*[_label_before(F.col("_text"), s) for s in services], _pointer_label(F.col(payload)))
    return df.withColumn("_text", text).withColumn(name, found).drop("_text")


# Order in which the service labels are tried.
DANTE_NAME_SERVICES = ["_netaudio-cmc", "_netaudio-arc", "_netaudio"]
NDI_NAME_SERVICES = ["_ndi"]
