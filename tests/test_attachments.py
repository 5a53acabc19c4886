import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from threadloom.operators import attachments as A

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
D = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def para(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


DOCX = zipped(**{"word__document.xml": f"<w:document {W}><w:body>{para('Plan', 'Heading1')}{para('one two')}{para('Cost', 'Heading2')}{para('three')}</w:body></w:document>"})
XLSX = zipped(
    **{
        "xl__workbook.xml": f'<workbook {S}><sheets><sheet name="Q1"/></sheets></workbook>', "xl__sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><t>bolt</t></si></sst>",
        "xl__worksheets__sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    }
)
PPTX = zipped(**{f"ppt__slides__slide{i}.xml": f"<p {D}><a:p><a:t>slide {i}</a:t></a:p></p>" for i in (10, 2)})


@pytest.mark.parametrize(
    "data, mime, name, want",
    [
        (b"caf\xe9", "text/plain", "a", ("text", "extracted", ["café"])), (b"<p>a</p><p>b</p>", "text/html; charset=x", None, ("html", "extracted", ["a\n\nb"])), (b" \n", None, "x.TXT", ("text", "empty", [])),
        (b'h1,h2\n"a\nb",2\n', "text/csv", "t.csv", ("csv", "extracted", ["h1\th2\na\nb\t2"])), (DOCX, "", "p.docx", ("docx", "extracted", ["Plan\none two", "Cost\nthree"])),
        (XLSX, "", "p.xlsx", ("xlsx", "extracted", ["[sheet: Q1]\nname\t\t5\nbolt\tx"])), (PPTX, "", "p.pptx", ("pptx", "extracted", ["slide 2", "slide 10"])), (b"no zip", "", "p.docx", ("docx", "error", [])),
        (b"\x89PNG", "image/png", "p.png", ("none", "unsupported", [])), (b"", "text/csv", "e.csv", ("csv", "empty", [])),
    ],
)
def test_handlers(data, mime, name, want):
    label, status, units = A.extracted(data, mime, name)
    assert (label, status, A.structural_chunks(units, 50)) == want


def test_packing():
    assert A.packed("a b\nc d e\nf\n\n", 4) == ["a b", "c d e\nf\n\n"] and A.packed("one two three four five", 2) == ["one two", "three four", "five"]
    assert A.packed_rows("[s]", ["h", "a b", "c d", "e f g h i j"], 7, len) == ["[s]\nh\na b", "[s]\nh\nc d", "[s]\nh\ne f g h i j"]
    assert A.packed_rows("", ["h"], 5) == ["h"] and A.packed("", 5) == []
    long = A.packed("w " * 1000, 64)
    assert all(A.count_tokens(c) <= 64 for c in long) and sum(map(A.count_tokens, long)) == 1000


def test_image_sizes():
    assert A.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 640, 480)) == (640, 480) and A.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert A.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 30)) == (30, 20)
    assert A.image_size(None) == A.image_size(b"") == A.image_size(b"\xff\xd8\xff") == A.image_size(b"\x89PNG\r\n\x1a\n") == (0, 0)


@pytest.fixture(scope="module")
def parts(spark):
    import hashlib

    def row(mid, thread, no, name, mime, data, inline=False, size=None):
        return mid, mid, thread, no, name, mime, inline, len(data) if size is None else size, hashlib.sha256(data).hexdigest(), data

    rows = [row("m1", "t1", 0, "a.txt", "text/plain", b"hello"), row("m2", "t2", 0, "b.txt", "text/plain", b"hello"), row("m1", "t1", 0, "a.txt", "text/plain", b"hello"), row("m3", "t1", 1, None, "image/png", b"pic", True), row("m4", "t1", 0, "bad", "x/y", b"short", size=99)]
    return spark.createDataFrame(rows, "message_key string, message_id string, thread_id string, part_no int, filename string, mime string, inline boolean, size bigint, sha256 string, data binary")


def test_store(spark, parts, tmp_path):
    root = str(tmp_path / "store")
    assert A.completeness(spark, root) == "empty"
    assert A.put(root, parts) == 3 and A.completeness(spark, root) == "partial"
    assert A.build_store(root, parts) == 0 and A.completeness(spark, root) == "complete"
    blobs = spark.read.parquet(f"{root}/blobs")
    assert blobs.count() == 2 and spark.read.parquet(f"{root}/rows").count() == 3
    sha = parts.where("filename = 'a.txt'").first()["sha256"]
    assert A.blob_bytes(spark, root, sha) == b"hello" and A.blob_bytes(spark, root, "00" * 32) is None


def test_documents_and_signals(spark, parts):
    good = parts.where("size < 50").dropDuplicates(["message_id", "sha256"])
    texts = A.attachment_texts(parts)
    assert {(r["extractor"], r["status"], r["text"]) for r in texts.collect()} == {("text", "extracted", "hello"), ("none", "unsupported", "")}
    docs = A.attachment_documents(good, texts).collect()
    assert {(d["parent_message_id"], d["text"], d["subject"], d["chunk_index"]) for d in docs} == {("m1", "hello", "attachment: a.txt", None), ("m2", "hello", "attachment: b.txt", None)}
    signals = good.where("filename = 'a.txt'").select("sha256", F.lit(1).alias("chars"), F.lit("2024").alias("measured_at"))
    assert A.unmeasured(good, signals).select("mime", "n_threads").collect() == [("image/png", 1)] and A.unmeasured(good, signals, largest=2).isEmpty() and A.unmeasured(good, signals.limit(0), images_only=True).count() == 1
    more = A.classify(good, signals.limit(0), lambda w: w.select("sha256", F.lit(2).alias("chars"), F.lit("2025").alias("measured_at")), 1)
    assert more.count() == 1 and A.classify(good, more, lambda w: w.select("sha256", F.lit(2).alias("chars"), F.lit("2025").alias("measured_at")), 5).count() == 2
    assert A.put_signals(signals, signals.withColumns({"chars": F.lit(9), "measured_at": F.lit("2023")})).first()["chars"] == 9
    assert A.kept_texts(spark.createDataFrame([("extracted",), ("ocr_unavailable",), ("binary",)], "status string")).count() == 1


def test_boilerplate(spark):
    rows = [("s", f"t{i}", True, "image/png", 19_999) for i in range(5)] + [("l", f"t{i}", True, "image/png", 20_000) for i in range(14)] + [("f", f"t{i}", False, "image/png", 10) for i in range(9)] + [("x", f"t{i}", True, "image/gif", 100_000) for i in range(30)] + [("n", "t", None, None, None)]
    df = spark.createDataFrame(rows, "sha256 string, thread_id string, inline boolean, mime string, size bigint")
    got = {r["sha256"]: r["boilerplate"] for r in A.with_boilerplate(df).collect()}
    assert got == {"s": True, "l": False, "f": False, "x": False, "n": False}
    told = {r["sha256"]: r["boilerplate"] for r in A.with_boilerplate(df, F.when(F.col("sha256") == "s", False)).collect()}
    assert told["s"] is False and told["l"] is False
