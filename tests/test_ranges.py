import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perfweave.sources import ranges

STAMPS = [b"[1/2/2024 3:4:5]", b"[28/12/2024 13:14:15]"]
LINE = st.one_of(
    st.sampled_from(STAMPS), st.just(b""), st.just(b"[not a stamp"), st.just(b"x" * 90),
    st.binary(max_size=30).map(lambda b: b.replace(b"\n", b"")),
)


def split_lines(data):
    parts = data.split(b"\n")
    out, at = [], 0
    for i, p in enumerate(parts):
        text = p + (b"\n" if i < len(parts) - 1 else b"")
        if text:
            out.append((at, text))
        at += len(text)
    return out


def split_blocks(data):
    out = []
    for at, line in split_lines(data):
        starts = ranges.re.match(ranges._STAMP, b"\n" + line)
        if starts or not out:
            out.append((at, line))
        else:
            out[-1] = (out[-1][0], out[-1][1] + line)
    return out


def read_all(data, step, blocks, base=0, hold=False, chunk=7, limit=None, **more):
    got = []
    f = io.BytesIO(data)
    size = len(data) if limit is None else limit
    for lo in range(base, size, step):
        hi = min(lo + step, size)
        for offsets, records, continues in ranges.read_range(f, lo, hi, base, blocks, hold, limit, chunk, **more):
            assert continues is None or len(records) == 1 and more
            got += [(*r, continues)[: 3 if more else 2] for r in zip(offsets.tolist(), records.to_pylist())]
    return got


STAT = b"  7  70  0.5%  0.25%  "
LONG_LINE = st.one_of(
    LINE, st.sampled_from([b"Thread: 3 Cpu usage: 1%", b" Time (ms)  Calls", STAT + b"ping", STAT + b"flush", STAT, b"b" * 70])
)


@settings(max_examples=300, deadline=None)
@given(st.lists(LONG_LINE, max_size=40), st.integers(1, 400), st.integers(1, 300), st.booleans())
def test_long_records_come_in_parts(lines, step, chunk, blocks):
    """Parts are the same however the file is cut and read, and make up the records."""
    data, most = b"\n".join(lines), 60
    before, ranges.LOOK_AHEAD_BYTES = ranges.LOOK_AHEAD_BYTES, 64
    try:
        got = read_all(data, step, blocks, chunk=chunk, most=most)
        assert got == read_all(data, len(data) + 1, blocks, chunk=len(data) + 1, most=most)
    finally:
        ranges.LOOK_AHEAD_BYTES = before
    at = 0
    for offset, record, continues in got:
        assert offset == at
        if continues is not None:
            first, head_bytes, head_lines = continues
            head, record = record[:head_bytes], record[head_bytes:]
            assert data[first:].startswith(head) and head.count(b"\n") == head_lines and record.startswith(STAT)
        at += len(record)
    assert at == len(data)
    records = split_blocks(data) if blocks else split_lines(data)
    assert {o for o, _ in records} <= {o for o, _, _ in got}
    stamped = [o for o, text in records if ranges.re.match(ranges._STAMP, b"\n" + text)]
    for offset, record, continues in got:
        if continues is None and offset not in stamped:
            assert len(record) <= most  # text without a stamp never takes more


@pytest.mark.parametrize("head", [b"", b"\n\r\r\n\r\n"])
def test_first_line_is_hashed_in_pieces(head):
    line = b"\r" * 3 + b"x" * (3 * ranges.PROBE_BYTES) + b"\r\rz"
    want = ranges.hashlib.sha256(line).hexdigest()
    for end in (b"", b"\r", b"\r\r\n", b"\nmore"):
        assert ranges.first_line_hash(io.BytesIO(head + line + end)) == want
    assert ranges.first_line_hash(io.BytesIO(head)) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(LINE, max_size=25), st.booleans(), st.integers(1, 200), st.integers(1, 120), st.booleans())
def test_any_cut_gives_the_same_records(lines, ends, step, chunk, blocks):
    data = b"\n".join(lines) + (b"\n" if ends and lines else b"")
    want = split_blocks(data) if blocks else split_lines(data)
    assert read_all(data, step, blocks, chunk=chunk) == want
    # Held-back end and its offset agree with each other.
    open_at = ranges.open_tail_offset(io.BytesIO(data), len(data), 0, blocks)
    held = read_all(data, step, blocks, hold=True, chunk=chunk)
    assert held == [r for r in want if r[0] < open_at]
    # Reading up to there with the file still growing gives the same.
    assert read_all(data + b"more", step, blocks, chunk=chunk, limit=open_at) == held


def test_resume_offset_starts_a_record():
    data = b"[1/2/2024 3:4:5]\nab\n[1/2/2024 3:4:6]\ncd\n"
    assert read_all(data, 10, True, base=20) == [(20, b"[1/2/2024 3:4:6]\ncd\n")]
    assert read_all(data, 10, False, base=17) == [(17, b"ab\n"), (20, b"[1/2/2024 3:4:6]\n"), (37, b"cd\n")]


@pytest.mark.parametrize("data, line", [
    (b"abc\ndef\n", b"abc"), (b"\n\r\n\r\r\nabc\r\n", b"abc"), (b"\rabc", b"\rabc"), (b"x" * 200_000, b"x" * 200_000),
])
def test_first_line_hash(data, line):
    assert ranges.first_line_hash(io.BytesIO(data)) == ranges.hashlib.sha256(line).hexdigest()


def test_first_line_hash_of_nothing():
    assert ranges.first_line_hash(io.BytesIO(b"")) is None
    assert ranges.first_line_hash(io.BytesIO(b"\r\n\n")) is None


def log(n, filler):
    return b"".join(b"[1/2/2024 3:%d:%d]%s\n" % (i // 60, i % 60, filler) for i in range(n))


@pytest.mark.parametrize("filler", [b"", b" Execution time: 3 ms - a - b", b"\n Time (ms)\n   some row"])
@pytest.mark.parametrize("step", [16, 100, 65536])
def test_seek_offset(filler, step):
    data = b"junk\n" + log(300, filler)
    first = ranges.first_stamp(io.BytesIO(data), 0, len(data), "UTC")[0]
    for i in (0, 1, 137, 299):
        at = ranges.seek_offset(io.BytesIO(data), len(data), first + i, "UTC", step)
        assert data[at:].startswith(b"[1/2/2024 3:%d:%d]" % (i // 60, i % 60))
    assert ranges.seek_offset(io.BytesIO(data), len(data), first + 300, "UTC", step) == len(data)
    assert ranges.seek_offset(io.BytesIO(data), len(data), 0, "UTC", step) == 5


def test_seek_is_not_misled_by_a_long_tail():
    data = log(10, b"") + b"no stamp here\n" * 1000
    first = ranges.first_stamp(io.BytesIO(data), 0, len(data), "UTC")[0]
    at = ranges.seek_offset(io.BytesIO(data), len(data), first + 5, "UTC", 64)
    assert data[at:].startswith(b"[1/2/2024 3:0:5]")


def test_paths_with_blanks_and_percent_signs(tmp_path):
    for name in ("lua_slow copy.log", "lua 100%.log", "lua%20slow.log"):
        (tmp_path / name).write_bytes(b"abc")
        for path in (f"{tmp_path}/{name}", f"file://{tmp_path}/{name}", f"file:{tmp_path}/{name}"):
            assert ranges.open_log(path).read() == b"abc"


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


@pytest.mark.parametrize("blocks", [False, True])
def test_a_range_is_not_read_far_beyond(blocks):
    data = (STAMPS[0] + b"\n" + b"x" * 80 + b"\n") * 20_000
    f = Counted(data)
    got = [records for _, records, _ in ranges.read_range(f, 0, 100_000, 0, blocks)]
    assert data.startswith(b"".join(r.as_py() for rs in got for r in rs)) and f.taken <= 100_000 + 2 * ranges.PROBE_BYTES
