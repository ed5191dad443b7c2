"""Media within media."""

import io
import zipfile

from farandole.llm import media

from test_text_operators import GIF, png


def stored_zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_files_within_files():
    p = png()
    inner = stored_zip(a=GIF, b=b"text")
    outer = stored_zip(first=inner, second=p)
    value = media.wave_of(b"head" + outer + b"tail")
    got = media.nested(value)
    at = [value.index(x) for x in (value, outer, inner, GIF, p)]
    assert got == [
        ("audio/wav", at[0], len(value), 0, -1),
        ("application/zip", at[1], len(outer), 1, 0),
        ("application/zip", at[2], len(inner), 2, 1),
        ("image/gif", at[3], len(GIF), 3, 2),
        ("image/png", at[4], len(p), 2, 1),
    ]
    assert media.sniff(outer) == [("application/zip", 0, len(outer))]
    # A file whose end would be past its parent's isn't in it.
    assert media.nested(media.wave_of(p[:-4]) + p[-4:])[1:] == []


def test_embedded_media_of_texts(spark):
    pdf = b"%PDF-1.4\n1 0 obj\n" + b"startxref\n9\n%%EOF"
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"  # all below 0x80
    docs = spark.createDataFrame([(1, "plain"), (2, (b"a " + pdf + b" b").decode()), (3, (gif + pdf).decode())], "doc_id long, text string")
    found = media.sniffed(media.text_media(docs), ["doc_id", "n_bytes"])
    told = {r.doc_id: dict(x.split("=") for x in r.feature.split(";")[1:]) for r in media.features(found).collect()}
    assert {i: (f["payload"], f["corrected"], f["embedded"], f["held"]) for i, f in told.items()} == {
        1: ("text/plain", "0", "0", ""),
        2: ("text/plain", "0", "1", "application/pdf"),
        3: ("image/gif", "1", "2", "application/pdf,image/gif"),
    }
    assert {(r.doc_id, r.depth, bytes(r.bytes)) for r in media.carved(found, ["doc_id"]).collect() if r.type != "audio/wav"} == {(2, 1, pdf), (3, 1, gif), (3, 1, pdf)}
