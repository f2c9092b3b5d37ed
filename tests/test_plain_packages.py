"""Plain packages are read without ``zipfile``, with the same outcome; parts that files share are made once."""

import io
import random
import time
import zipfile

import pyarrow as pa
import pytest

from paperloom.sources import packages

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _parts(i):
    return [
        ("xl/workbook.xml", f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="One" sheetId="1" r:id="r7"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="r7" Type="{OFFICE}/worksheet" Target="worksheets/first.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", "<sst><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>"),
        ("xl/worksheets/first.xml", f'<worksheet><row><c r="A1" t="s"><v>1</v></c><c r="AB1"><v>{i}</v></c></row><row><c r="B2" t="b"><v>1</v></c><c r="x" t="s"><v>9</v></c></row></worksheet>'),
    ]


def _rows(i):
    return [(1, "One", 1, ["bc", *[""] * 26, str(i)]), (1, "One", 2, ["", "TRUE", ""])]


read = packages._opened(packages._sheet_rows)


def _zipped(parts, method=zipfile.ZIP_DEFLATED, comment=b""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", method) as archive:
        for name, text in parts:
            archive.writestr(name, text)
        archive.comment = comment
    return held.getvalue()


def test_books_without_zipfile(monkeypatch):
    made = [packages.pack(_parts(i)) for i in range(50)] + [_zipped(_parts(50)), _zipped(_parts(51), zipfile.ZIP_STORED)]
    parsed = []
    parse = packages.ElementTree.fromstring
    monkeypatch.setattr(packages.ElementTree, "fromstring", lambda data: parsed.append(data) or parse(data))
    monkeypatch.setattr(packages.zipfile, "ZipFile", None)
    assert [list(read(m)) for m in made] == [_rows(i) for i in range(52)]
    assert len(parsed) <= 52 + 3  # the sheets, and each shared part once


def test_books_in_less_time_than_zipfile_alone():
    made = [packages.pack(_parts(i)) for i in range(1_000)]

    def opened(data):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return [archive.read(n) for n in archive.namelist()]

    def least(f):
        times = []
        for _ in range(3):
            began = time.process_time()
            for m in made:
                list(f(m))
            times.append(time.process_time() - began)
        return min(times)

    assert least(read) < least(opened)


def _outcome(f):
    try:
        return f()
    except packages.BROKEN:
        return "broken"


def _by_zipfile(data):
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return list(packages._sheet_rows(archive))


def test_same_as_zipfile_on_odd_packages():
    draw = random.Random(7)
    twice = packages.pack([*_parts(1), _parts(2)[3]])  # a name twice: the last one counts
    whole = [packages.pack(_parts(0)), _zipped(_parts(0)), _zipped(_parts(0), zipfile.ZIP_STORED), twice]
    odd = [b"", b"PK\5\6" + bytes(18), whole[0] + b"x", b"x" + whole[0], _zipped(_parts(0), comment=b"hi"), _zipped([*_parts(0), ("é", "x")]), _zipped(_parts(0)[1:]), *whole]
    for _ in range(1_500):
        data = bytearray(draw.choice(whole))
        for _ in range(draw.randrange(1, 4)):
            at = draw.randrange(len(data))
            if draw.random() < 0.8:
                data[at] ^= 1 << draw.randrange(8)
            else:
                del data[at : at + draw.randrange(1, 20)]
        odd.append(bytes(data))
    got = [_outcome(lambda d=d: list(read(d))) for d in odd]
    assert got == [_outcome(lambda d=d: _by_zipfile(d)) for d in odd]
    plain = [packages.PlainPackage.of(d) is not None for d in odd]
    assert sum(plain) > 300 and sum(p and g == "broken" for p, g in zip(plain, got)) > 100 and _rows(0) in got and read(twice).__next__()[3][-1] == "2"
    with pytest.raises(zipfile.BadZipFile):
        list(read(None))


def test_long_parts_are_not_remembered():
    strings = lambda k: f"<sst><si><t>{k}</t></si>{'<x/>' * packages.REMEMBERED_SIZE}</sst>"
    known = packages._inflated_lately.cache_info().currsize
    for k in "xyz":
        parts = [(n, strings(k) if n == "xl/sharedStrings.xml" else t.replace("<v>1</v>", "<v>0</v>")) for n, t in _parts(0)]
        assert list(read(packages.pack(parts)))[0][3][0] == k
    assert packages._inflated_lately.cache_info().currsize <= min(known + 3, packages.REMEMBERED)  # the short parts


def test_entries_of_maps():
    draw = random.Random(1)
    maps = [None if draw.random() < 0.2 else [(str(i), draw.choice([None, "", "é😀", "x" * 30])) for i in range(draw.randrange(4))] for _ in range(400)]
    array = pa.array(maps, pa.map_(pa.string(), pa.string()))
    for a in range(0, 401, 57):
        for n in (0, 1, 100):
            assert list(packages._entries(array.slice(a, n))) == [m or [] for m in maps[a : a + n]]
