"""Blocks written and read in whole arrays, against a reading one by one."""

import random

import pyarrow as pa
import pytest

from mapquarry.sources import pbf, wire, writer

TEXT_MAP = pa.map_(pa.string(), pa.string())
MEMBERS = pa.list_(pa.struct([("member_id", pa.int64()), ("member_type", pa.string()), ("member_role", pa.string())]))


def made(kind, n, seed=1):
    r = random.Random(seed)
    number = lambda: r.choice([0, 1, -1, 127, 128, r.randrange(1 << 20), -r.randrange(1 << 40), (1 << 62) - r.randrange(9)])
    texts = ["", "yes", "Ä", "name", "日本", "x" * 300]
    tags = [r.choice([None, [(k, r.choice([*texts, None])) for k in r.sample(texts, r.randrange(len(texts)))]]) for _ in range(n)]
    refs = [r.choice([None, [number() for _ in range(r.randrange(6))]]) for _ in range(n)]
    member = lambda: {"member_id": number(), "member_type": r.choice(pbf.MEMBER_TYPES), "member_role": r.choice([None, *texts])}
    members = [r.choice([None, [member() for _ in range(r.randrange(5))]]) for _ in range(n)]
    about = {"id": [number() for _ in range(n)], "tags": pa.array(tags, TEXT_MAP), "version": pa.array([r.choice([None, 1, 70000]) for _ in range(n)], pa.int32())}
    about |= {"changeset": pa.array([r.choice([None, 5]) for _ in range(n)], pa.int64()), "timestamp": pa.array([r.choice([None, 1_600_000_000]) for _ in range(n)], pa.int64()), "visible": pa.array([r.choice([None, True, False]) for _ in range(n)])}
    about |= {"way": {"refs": pa.array(refs, pa.list_(pa.int64()))}, "relation": {"members": pa.array(members, MEMBERS)}, "node": {"lon": [k / 7 % 180 for k in range(n)], "lat": [-k / 11 % 90 for k in range(n)]}}[kind]
    return pa.table(about)


def one_by_one(data, kind, keys=None, metadata=True):
    b, rows = pbf._block(data), pbf._Rows(kind, keys, metadata)
    for group in b.groups:
        for number, _, value in wire.fields(group):
            rows.dense(b, value) if number == 2 else rows.one(b, value)
    return rows.batch()


@pytest.mark.parametrize("kind", ["node", "way", "relation"])
@pytest.mark.parametrize("history", [False, True])
def test_blocks(kind, history):
    whole = made(kind, 500)
    for rows in (whole, whole.slice(100, 37).combine_chunks(), whole.slice(3, 1).combine_chunks()):
        data = getattr(writer, f"{kind}_block")(rows, history)
        for keys, metadata in ((None, True), (frozenset(["name", ""]), False)):
            got = pbf.decode(data, kind, keys, metadata)
            assert got.equals(one_by_one(data, kind, keys, metadata))
        got = pbf.decode(data, kind).to_pydict()
        want = rows.to_pydict()
        assert got["id"] == want["id"]
        assert [dict(t) for t in got["tags"]] == [{k: v for k, v in t or [] if v is not None} for t in want["tags"]]
        if kind == "way":
            assert got["refs"] == [x or [] for x in want["refs"]]
        if kind == "relation":
            assert got["members"] == [[m | {"member_role": m["member_role"] or ""} for m in x or []] for x in want["members"]]
        if history:
            assert got["visible"] == [bool(x) for x in want["visible"]]


@pytest.mark.parametrize("kind", ["way", "relation"])
def test_usual_blocks_are_read_in_whole_arrays(kind):
    data = getattr(writer, f"{kind}_block")(made(kind, 50))
    b = pbf._block(data)
    messages = [v for g in b.groups for _, _, v in wire.fields(g)]
    assert pbf._batch(b, messages, kind, None, True).equals(one_by_one(data, kind))


def test_unusual_messages_are_read_one_by_one():
    """A key twice, a field of eight bytes, text that is no number, a number within a field that is unknown."""
    strings = wire.field(1, b"".join(wire.field(1, s) for s in (b"", b"a", b"b", b"a")))
    way = lambda *more: wire.field(3, wire.field(1, 7) + wire.field(8, wire.pack_signed([1, 2])) + b"".join(more))
    twice = wire.field(2, wire.pack([1, 3])) + wire.field(3, wire.pack([1, 2]))
    for odd in (twice, wire.varint(50 << 3 | 1) + b"12345678", wire.field(60, b"\xff\xff"), wire.field(61, 5), wire.field(62, b"\x80" * 12 + b"\x01")):
        data = strings + wire.field(2, way() + way(odd))
        assert pbf.decode(data, "way").equals(one_by_one(data, "way"))
    with pytest.raises((ValueError, IndexError)):
        pbf.decode(strings + wire.field(2, wire.field(3, wire.field(1, 7) + b"\x42\x09\x01")), "way")
