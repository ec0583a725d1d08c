"""A log that grows between calls, is emptied, and is handed over again after a failure."""

import pytest

from flowguard.sources.tables import tail_log


def test_each_line_once(spark, tmp_path):
    log, got = tmp_path / "log", {}
    log.mkdir()

    def call(fail=False):
        def sink(lines, run):
            got[run] = [r.line for r in lines.orderBy("path", "place").collect()]
            if fail:
                raise RuntimeError("lost")

        return tail_log(spark, str(log), str(tmp_path / "state"), sink)

    def append(name, data, mode="ab"):
        with open(log / name, mode) as f:
            f.write(data)

    append("a", "one\ntwé\nhal".encode())
    assert call() == 0 and got[0] == ["one", "twé"]
    append("a", "f é".encode()[:-1])  # in the middle of a character
    assert call() == 1 and got[1] == []
    append("a", "é".encode()[-1:] + b"\n\nlast\n")
    append("b", b"other\n")
    with pytest.raises(RuntimeError):
        call(fail=True)
    assert call() == 2 and got[2] == ["half é", "", "last", "other"]
    append("a", b"new\n", "wb")  # emptied and begun anew
    assert call() == 3 and got[3] == ["new"]
    assert call() == 4 and got[4] == []
