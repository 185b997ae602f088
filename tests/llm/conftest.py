import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables, all others empty; extra columns by a second schema."""

    def write(extra="", **rows):
        for name, schema in SCHEMAS.items():
            more = f", {extra}" if extra and name in rows else ""
            spark.createDataFrame(rows.get(name, []), schema + more).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


LONG = "Eine lange Zeile ohne Ende und mit vielen Wörtern darin. " * 6000

#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD_DOCS = [
    (1, "A first line that is long enough\nshort\nA first line that is long enough", "en", "s1", 10),
    (2, "a FIRST line that is long enough  \nother words here", "en", "s1", 10),
    (3, "\tA first line that is long enough", None, "s2", None),
    (4, "", "en", "s2", 0),
    (5, None, "en", None, 0),
    (6, LONG, "de", "s3", len(LONG)),
    (7, LONG, "de", "s3", len(LONG)),
    (8, "one two three four five six seven eight nine ten", "en", "s3", 1),
    (8, "one two three four five six seven eight nine ten", "en", "s3", 1),
    (None, "no id here but words enough to be a text", "en", "s1", 1),
    (9, " \t\n\x0b\x0c\r ", "en", "", 7),
    (10, "日本語のテキスト 🙂 mixed <|endoftext|> marks", "ja", "Ω", 30),
]
