import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.sources import containers

FREE, END, FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def compound(streams):
    """A compound file with streams by path; small ones go to the mini stream."""
    sectors, fat = [], []

    def put(data):
        if not data:
            return END
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), END])
        return first

    mini, mini_fat, entries = b"", [], [["Root Entry", 5, FREE, FREE, 1, END, 0]]
    folders = sorted({p.rpartition("/")[0] for p in streams} - {""})
    nodes = {"": []}
    for f in folders:
        nodes[f] = []
        nodes[""].append((f, 1, None))
    for p, data in streams.items():
        nodes[p.rpartition("/")[0]].append((p.rpartition("/")[2], 2, data))
    where = {}
    for folder in ["", *folders]:
        where[folder] = len(entries)
        for k, (name, kind, data) in enumerate(nodes[folder]):
            right = len(entries) + 1 if k + 1 < len(nodes[folder]) else FREE
            if data is None:
                entries.append([name, 1, FREE, right, name, END, 0])
            elif len(data) >= 4096:
                entries.append([name, 2, FREE, right, FREE, put(data), len(data)])
            else:
                first, n = len(mini_fat), -(-len(data) // 64)
                mini += data.ljust(n * 64, b"\0")
                mini_fat.extend([*range(first + 1, first + n), END])
                entries.append([name, 2, FREE, right, FREE, first, len(data)])
    entries[0][5], entries[0][6] = put(mini), len(mini)
    raw = b""
    for name, kind, left, right, child, first, size in entries:
        n = name.encode("utf-16-le") + b"\0\0"
        raw += n.ljust(64, b"\0") + struct.pack("<HBBIII", len(n), kind, 1, left, right, where[child] if isinstance(child, str) else child) + b"\0" * 36 + struct.pack("<IQ", first, size)
    directory, mini_at = put(raw), put(struct.pack(f"<{len(mini_fat)}I", *mini_fat))
    table = len(sectors)
    fat.append(FAT)
    sectors.append(struct.pack("<128I", *fat, *[FREE] * (128 - len(fat))))
    head = containers.OLE_MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<II", 0, 1)
    head += struct.pack("<I4xIIIII", directory, 4096, mini_at, 1, END, 0) + struct.pack("<109I", table, *[FREE] * 108)
    return head + b"".join(sectors)


def record(tag, level, data):
    if len(data) < 0xFFF:
        return struct.pack("<I", tag | level << 10 | len(data) << 20) + data
    return struct.pack("<II", tag | level << 10 | 0xFFF << 20, len(data)) + data


def hwp(sections, packed=True):
    squeeze = lambda b: zlib.compress(b)[2:-4] if packed else b
    streams = {"FileHeader": b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", int(packed)) + b"\0" * 216}
    for i, texts in sections.items():
        body = b"".join(record(66, 0, b"\0" * 22) + record(67, 1, t if isinstance(t, bytes) else t.encode("utf-16-le")) for t in texts)
        streams[f"BodyText/Section{i}"] = squeeze(body)
    return compound(streams)


def hwpx(sections):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, body in sections.items():
            z.writestr(f"Contents/section{i}.xml", f'<hs:sec xmlns:hs="s" xmlns:hp="p">{body}</hs:sec>')
    return out.getvalue()


@pytest.mark.parametrize("packed", [True, False])
def test_hwp(packed):
    control = struct.pack("<8H", 11, 1, 2, 3, 4, 5, 6, 11)  # a table's anchor takes eight units
    rng = "".join(chr(0xAC00 + i * 7919 % 11000) for i in range(9000))
    got = containers.decode_hwp(hwp({10: ["열째"], 2: ["둘째", control + "뒤".encode("utf-16-le") + b"\x0d\x00"], 0: [rng, ""]}, packed))
    assert [p["text"] for p in got["paragraphs"]] == [rng, "둘째", "뒤", "열째"]
    assert (got["record_count"], got["para_text_count"]) == (10, 5) and all(p["level"] == 1 for p in got["paragraphs"])


def test_hwpx():
    p = lambda t: f"<hp:p><hp:run><hp:t>{t}</hp:t></hp:run></hp:p>"
    table = "<hp:p><hp:run><hp:t>밖</hp:t><hp:tbl><hp:tc>" + p("안 &amp; 속") + "</hp:tc></hp:tbl></hp:run></hp:p>"
    got = containers.decode_hwpx(hwpx({10: p("열째"), 0: p("a&lt;b") + table + p(" ")}))
    assert [(x["level"], x["text"]) for x in got["paragraphs"]] == [(0, "a<b"), (0, "밖"), (1, "안 & 속"), (0, "열째")]


def test_files_and_damage(spark, tmp_path):
    good = hwp({0: ["본문 하나", "본문 둘"]})
    files = {"a.hwp": good, "b.hwpx": hwpx({0: "<hp:p><hp:t>x</hp:t></hp:p>"}), "c.hwp": good[:700], "d.hwpx": b"PK\x03\x04broken", "e.pdf": b"%PDF-1.4", "f.txt": b"?", "g.hwp": b"", "h.hwpx": hwpx({0: "<hp:p>"})}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    out = {r.path.rpartition("/")[2]: r for r in containers.read_documents(spark, str(tmp_path)).withColumn("t", containers.document_text(F.col("paragraphs"))).collect()}
    assert len(out) == 7 and out["a.hwp"].t == "본문 하나\n\n본문 둘" and out["a.hwp"].error is None and out["b.hwpx"].t == "x"
    assert all(out[n].error and not out[n].paragraphs for n in out if n not in ("a.hwp", "b.hwpx"))
    assert (out["a.hwp"].record_count, out["a.hwp"].para_text_count, out["e.pdf"].format, out["f.txt"].format) == (4, 2, "pdf", None)
