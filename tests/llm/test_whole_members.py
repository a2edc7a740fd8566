"""Archives with several records in one gzip member."""

import gzip
import random

from quillspark.llm import warc

# payloads that don't compress, so that damage hits one record
RECORDS = [warc.record("response", str(i), f"http://h/{i}", random.Random(i).randbytes(20_000)) for i in range(8)]


def ids(found):
    return [int(x.fields["warc-record-id"][10:-1]) for x in found if isinstance(x, warc.Record)]


def gaps(found):
    return [x for x in found if isinstance(x, warc.Gap)]


def test_a_bad_record_leaves_the_others_of_its_member():
    bad = bytearray(RECORDS[3])
    bad[-100] ^= 1
    data = warc.member(b"".join([*RECORDS[:3], bytes(bad), *RECORDS[4:6]])) + warc.member(RECORDS[6])
    found = list(warc.salvage(data))
    assert ids(found) == [0, 1, 2, 4, 5, 6]
    (gap,) = gaps(found)
    start = sum(map(len, RECORDS[:3]))
    assert (gap.start, gap.end) == (0, len(data) - len(warc.member(RECORDS[6])))
    assert gap.reason == f"block digest differs (bytes {start} to {start + len(bad)} of the member's content)"


def test_a_member_cut_short_or_damaged_late_gives_what_came_before():
    whole, last = warc.member(b"".join(RECORDS[:6])), warc.member(RECORDS[6])
    cut = whole[: len(whole) * 3 // 4]
    assert ids(warc.salvage(cut)) == [0, 1, 2, 3]
    found = list(warc.salvage(cut + last))
    assert ids(found) == [0, 1, 2, 3, 6] and [(x.start, x.end) for x in gaps(found)] == [(0, len(cut))]
    trailer = bytearray(whole)
    trailer[-6] ^= 1
    found = list(warc.salvage(bytes(trailer) + last))
    assert ids(found) == [0, 1, 2, 3, 4, 5, 6] and "incorrect data check" in gaps(found)[0].reason
    late = bytearray(whole)
    late[len(late) * 3 // 4 :] = b"\xff" * (len(late) - len(late) * 3 // 4)
    assert ids(warc.salvage(bytes(late) + last)) == [0, 1, 2, 3, 6]


def test_records_of_stored_blocks_come_once():
    stored = gzip.compress(b"".join(RECORDS[:6]), 0)
    for data in (stored[:-100], stored[:-8] + b"\0" * 8):
        found = ids(warc.salvage(data + warc.member(RECORDS[6])))
        assert len(found) == len(set(found)) and {0, 1, 2, 3, 4, 6} <= set(found)


def test_records_without_a_digest_are_not_trusted_in_a_damaged_member():
    bare = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = bytearray(warc.member(bare + RECORDS[0]))
    data[-6] ^= 1
    found = list(warc.salvage(bytes(data)))
    assert ids(found) == [0] and "no digest" in gaps(found)[0].reason
