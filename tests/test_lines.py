"""The line assembler against a plain loop over the lines."""

import random

import pytest

from mailsift.operators import lines


def plain(text, boundary="blank", reset=True, with_date=True):
    """Records of one file, line by line."""
    heads = {"subject": "Subject:", "from": "From:", "receiver": "To:", "date": "Date:"}
    if not with_date:
        del heads["date"]
    records, part, held = [], [], []

    def close():
        nonlocal part, held
        subject = [v for k, v in part if k == "subject"]
        full = (subject and subject[-1] != "") or any(k == "body" for k, _ in part)
        held += part
        part = []
        if full:
            records.append(held)
            held = []

    for raw in text:
        line = raw.strip()
        kind = next((k for k, p in heads.items() if line.startswith(p)), "blank" if line == "" else "body")
        if kind == boundary:
            close()
        if kind != "blank":
            part.append((kind, line[len(heads[kind]) :].strip() if kind in heads else line))
    close()
    out = []
    for r in records:
        body, after = [], True
        for k, v in r:
            if k == "body":
                if after and reset:
                    body = []
                body.append(v)
            after = k != "body"
        fields = {k: next((v for n, v in reversed(r) if n == k), None) for k in heads}
        fields["subject"] = fields["subject"] or ""
        subject = [v for k, v in r if k == "subject"]
        if not body and not (subject and subject[-1]):
            continue
        out.append((*[fields[k] for k in heads], ("" if reset or not body else " ") + " ".join(body)))
    return out


def as_lines(spark, files, block):
    rows = [(f, n // block, n, t) for f, text in files.items() for n, t in enumerate(text)]
    return spark.createDataFrame(rows, "file string, block long, line_no long, line string").repartition(5)


@pytest.mark.parametrize("boundary, reset, with_date", [("blank", True, True), ("subject", True, True), ("blank", False, False)])
@pytest.mark.parametrize("block", [3, 1000])
def test_records_equal_a_plain_loop(spark, boundary, reset, with_date, block):
    rng = random.Random(11)
    kinds = ["Subject: s{}", "Subject:", "From: f{}", "To: t{}", "Date: d{}", "body {}", "more {}", "", "  ", "text {}"]
    files = {f"f{k}": [rng.choice(kinds).format(n) for n in range(rng.randint(0, 60))] for k in range(12)}
    files["unbroken"] = ["Subject: one", "From: x"] + [f"line {n}" for n in range(300)]
    files["heads"] = ["From: a", "", "To: b", "", "Subject:", ""]
    got = lines.assemble(as_lines(spark, files, block), boundary, "reset" if reset else "append", with_date)
    names = ["subject", "from", "receiver", *(["date"] if with_date else []), "body"]
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.file, r.rec)):
        found.setdefault(r.file, []).append(tuple(r[c] for c in names))
    assert found == {f: w for f, t in files.items() if (w := plain(t, boundary, reset, with_date))}


def test_no_array_of_lines_is_made(spark):
    df = lines.assemble(as_lines(spark, {"f": ["Subject: a", "b"]}, 1))
    assert "collect_list" not in df._jdf.queryExecution().toString().lower()
