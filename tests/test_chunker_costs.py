"""What chunkers do once a file or line that they could do often."""

import io
import zipfile
from datetime import datetime

import pytest

from corpusgraph.operators.chunking import REGISTRY, Source, log, office
from corpusgraph.plans import formats


@pytest.mark.parametrize("line", ['{"ts": "2024-01-15 10:00:01"}', "2024-01-15T10:00:01Z INFO x", "2024-01-15T12:00:01+02:00 x"])
def test_common_times_try_no_layout(monkeypatch, line):
    class Untried(datetime):
        @classmethod
        def strptime(cls, text, layout):
            raise AssertionError(layout)

    monkeypatch.setattr(log, "datetime", Untried)
    assert log.time_of(line).isoformat() == "2024-01-15T10:00:01"


@pytest.mark.parametrize("line", ["2024-02-30T10:00:01Z", "2024-01-15T24:00:00", "2024-01-15T10:00:60", "2024-01-15T10:00:01+9900", "0000-01-15 10:00:01"])
def test_no_times(line):
    assert log.time_of(line) is None


def test_rare_times():
    rare = {"2024-01-15T10:00:01.123+02:00": "2024-01-15T08:00:01.123000", "2024-01-15 10:00:01,123": "2024-01-15T10:00:01.123000", "15/Jan/2024:10:00:01 +0200": "2024-01-15T08:00:01", "Jan 15 10:00:01": "1900-01-15T10:00:01"}
    assert {k: log.time_of(k).isoformat() for k in rare} == rare


@pytest.mark.parametrize(("name", "text", "path"), [("word/document.xml", formats._DOCX, "a.docx"), ("content.xml", formats._ODT, "a.odt")])
def test_an_archive_is_opened_once(monkeypatch, name, text, path):
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr(name, text)
    opened, real = [], zipfile.ZipFile
    monkeypatch.setattr(office.zipfile, "ZipFile", lambda *a: opened.append(1) or real(*a))
    assert len(REGISTRY.chunk(Source(file.getvalue(), path=path))[1]) == 3 and len(opened) == 1
