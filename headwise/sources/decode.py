"""Payload decoding: archived GTFS-realtime bytes to nested feed rows.

The message layout is that of the public GTFS-realtime specification, limited to
the fields used here; every other field stays unknown and is ignored. Decoding
is a map over rows: each payload is one poll, no rows meet, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas

# Field numbers and types of the public specification. "*" marks repeated fields.
# schedule_relationship is read as a plain number so that unknown values survive.
MESSAGES = {
    "FeedMessage": {"header": (1, "FeedHeader"), "entity": (2, "*FeedEntity")},
    "FeedHeader": {
        "gtfs_realtime_version": (1, "string"),
        "incrementality": (2, "int32"),
        "timestamp": (3, "uint64"),
    },
    "FeedEntity": {
        "id": (1, "string"),
        "is_deleted": (2, "bool"),
        "trip_update": (3, "TripUpdate"),
        "vehicle": (4, "Opaque"),
        "alert": (5, "Opaque"),
        "shape": (6, "Opaque"),
        "stop": (7, "Opaque"),
        "trip_modifications": (8, "Opaque"),
    },
    "Opaque": {},
    "TripUpdate": {
        "trip": (1, "TripDescriptor"),
        "stop_time_update": (2, "*StopTimeUpdate"),
        "vehicle": (3, "VehicleDescriptor"),
        "timestamp": (4, "uint64"),
    },
    "TripDescriptor": {
        "trip_id": (1, "string"),
        "route_id": (5, "string"),
        "modified_trip": (7, "ModifiedTripSelector"),
    },
    "ModifiedTripSelector": {"modifications_id": (1, "string"), "affected_trip_id": (2, "string")},
    "VehicleDescriptor": {"id": (1, "string")},
    "StopTimeUpdate": {
        "stop_sequence": (1, "uint32"),
        "arrival": (2, "StopTimeEvent"),
        "departure": (3, "StopTimeEvent"),
        "stop_id": (4, "string"),
        "schedule_relationship": (5, "int32"),
    },
    "StopTimeEvent": {"time": (2, "int64")},
}
# Census names of the payload kinds.
KIND_NAMES = {
    "trip_update": "tripUpdate",
    "vehicle": "vehicle",
    "alert": "alert",
    "shape": "shape",
    "stop": "stop",
    "trip_modifications": "tripModifications",
}
INCREMENTALITY = {0: "FULL_DATASET", 1: "DIFFERENTIAL"}
RELATIONSHIPS = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA", 3: "UNSCHEDULED"}


@lru_cache(maxsize=1)
def feed_message():
    """The FeedMessage class, built once per Python worker."""
    try:
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
    except ImportError as missing:  # pragma: no cover - depends on the cluster image
        raise RuntimeError("decoding payloads needs the protobuf package on the executors") from missing

    kinds = descriptor_pb2.FieldDescriptorProto
    scalar = {
        "string": kinds.TYPE_STRING,
        "int32": kinds.TYPE_INT32,
        "uint32": kinds.TYPE_UINT32,
        "int64": kinds.TYPE_INT64,
        "uint64": kinds.TYPE_UINT64,
        "bool": kinds.TYPE_BOOL,
    }
    file = descriptor_pb2.FileDescriptorProto(name="headwise_rt.proto", package="headwise_rt", syntax="proto2")
    for message, fields in MESSAGES.items():
        described = file.message_type.add(name=message)
        for name, (number, kind) in fields.items():
            label = kinds.LABEL_REPEATED if kind.startswith("*") else kinds.LABEL_OPTIONAL
            field = described.field.add(name=name, number=number, label=label)
            kind = kind.lstrip("*")
            if kind in scalar:
                field.type = scalar[kind]
            else:
                field.type = kinds.TYPE_MESSAGE
                field.type_name = f".headwise_rt.{kind}"
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("headwise_rt.FeedMessage"))


def _get(message, name):
    return getattr(message, name) if message is not None and message.HasField(name) else None


def _stop(update) -> dict:
    relationship = _get(update, "schedule_relationship")
    return {
        "stop_sequence": _get(update, "stop_sequence"),
        "stop_id": _get(update, "stop_id"),
        "schedule_relationship": None if relationship is None else RELATIONSHIPS.get(relationship, str(relationship)),
        "arrival_time": _get(_get(update, "arrival"), "time"),
        "departure_time": _get(_get(update, "departure"), "time"),
    }


def _trip_update(update) -> dict:
    trip = _get(update, "trip")
    modified = _get(trip, "modified_trip")
    return {
        "trip": {
            "trip_id": _get(trip, "trip_id"),
            "route_id": _get(trip, "route_id"),
            "modified_trip": modified and {
                "modifications_id": _get(modified, "modifications_id"),
                "affected_trip_id": _get(modified, "affected_trip_id"),
            },
        },
        "vehicle_id": _get(_get(update, "vehicle"), "id"),
        "ts": _get(update, "timestamp"),
        "stop_time_update": [_stop(s) for s in update.stop_time_update],
    }


def decode_payload(payload: bytes | None) -> dict:
    """One payload as a feed dict, or a dict with only ``error`` set."""
    failed = {"header_ts": None, "version": None, "incrementality": None, "entities": None}
    try:
        feed = feed_message()()
        feed.ParseFromString(payload or b"")
    except RuntimeError:
        raise
    except Exception:  # the parser's error class differs between builds
        return {**failed, "error": "unreadable_payload"}
    header = _get(feed, "header")
    stamp = _get(header, "timestamp")
    if stamp is None:
        return {**failed, "error": "no_header_time"}
    return {
        "header_ts": stamp * 1_000_000,
        "version": _get(header, "gtfs_realtime_version"),
        "incrementality": INCREMENTALITY.get(_get(header, "incrementality")),
        "entities": [
            {
                "id": e.id,
                "kinds": [label for field, label in KIND_NAMES.items() if e.HasField(field)],
                "trip_update": _trip_update(e.trip_update) if e.HasField("trip_update") else None,
            }
            for e in feed.entity
        ],
        "error": None,
    }


def decode_polls(polls: DataFrame) -> DataFrame:
    """Decode ``payload`` of archived polls; bad payloads get ``error`` instead.

    The poll id is (feed, fetch time), which is unique to a fetch.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schemas.DECODED)
    arrow = to_arrow_schema(wanted)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A record batch for each poll: no more than one decoded feed is held at a time.
        for batch in batches:
            for n in range(batch.num_rows):
                (poll,) = batch.slice(n, 1).to_pylist()
                row = {c: poll[c] for c in ("poll_id", "feed", "fetched_at")} | decode_payload(poll["payload"])
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    keyed = polls.select(
        F.concat_ws("@", "feed", F.unix_micros("fetched_at").cast("string")).alias("poll_id"),
        "feed",
        "fetched_at",
        "payload",
    )
    return keyed.mapInArrow(decode, wanted)


def good_feeds(decoded: DataFrame) -> DataFrame:
    return decoded.filter("error is null").drop("error")


def quarantine(decoded: DataFrame) -> DataFrame:
    """Polls whose payload could not be read; their bytes stay in the archive."""
    return decoded.filter("error is not null").select("poll_id", "feed", "fetched_at", "error")
