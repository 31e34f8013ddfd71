import csv
import hashlib
import json
import random
from datetime import UTC, datetime

import pytest
from roadglass import cli
from roadglass.operators import profile
from roadglass.sources import delimited

SPATIAL = """event_id,event_datetime,latitude,longitude,district,exposure
1,2025-01-01T08:00:00,-12.04,-77.04,Lima,10
2,2025-01-02T09:30:00,-12.05,-77.05,La Victoria,12
2,2025-01-02T09:30:00,-12.05,-77.05,La Victoria,12
3,,,-77.02,Miraflores,
"""


def write(tmp_path, content, name="data.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(content.encode(encoding))
    return path


def oracle(path, delimiter=None, cap=profile.UNIQUE_CAP):
    """The report by plain row-by-row Python, from the rules of the blueprint."""
    nulls, bools = {"", "na", "n/a", "null", "none", "nan"}, {"true", "false", "yes", "no", "si", "sí"}
    missing = lambda v: v is None or v.strip().casefold() in nulls

    def kind(v):
        if v.casefold() in bools:
            return "boolean", None
        for name, f in (("integer", int), ("float", float)):
            try:
                return name, float(f(v))
            except ValueError:
                pass
        try:
            return "datetime", datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            pass
        for f in ("%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%Y/%m/%d %H:%M:%S"):
            try:
                return "datetime", datetime.strptime(v, f)
            except ValueError:
                pass
        return "string", None

    with open(path, encoding="utf-8-sig", newline="") as f:
        reader = csv.reader(f, delimiter=delimiter or delimited.sniff(path))
        rows = [r for r in reader if r]
    names, rows = rows[0], rows[1:]
    full = [r[: len(names)] + [None] * (len(names) - len(r)) for r in rows]
    columns = []
    for i, name in enumerate(names):
        values = [r[i].strip() for r in full if not missing(r[i])]
        seen, capped = [], False
        known = set()
        for v in values:
            if len(known) >= cap:
                capped = True
            elif v not in known:
                known.add(v)
                seen.append(v)
        kinds = [kind(v) for v in values]
        count = lambda *k: sum(x in k for x, _ in kinds)  # noqa: E731, B023
        families = {"boolean": count("boolean"), "numeric": count("integer", "float"), "datetime": count("datetime")}
        label, pct = "empty", None
        if values:
            best = max(families, key=families.get)
            label = "string"
            if families[best] / len(values) >= 0.9:
                pct = round(families[best] / len(values) * 100, 2)
                label = ("float" if count("float") else "integer") if best == "numeric" else best
        low = high = None
        if label in ("integer", "float"):
            xs = [x for k, x in kinds if k in ("integer", "float")]
            low, high = profile.shown_number(min(xs)), profile.shown_number(max(xs))
        elif label == "datetime":
            xs = [x for k, x in kinds if k == "datetime"]
            low, high = min(xs).isoformat(), max(xs).isoformat()
        n = len(full)
        columns.append(
            {"name": name, "inferred_type": label, "non_null_count": len(values), "null_count": n - len(values), "null_pct": round((n - len(values)) / n * 100, 2) if n else 0.0,
             "unique_count": len(known), "unique_count_is_capped": capped, "parse_success_pct": pct, "minimum": low, "maximum": high, "sample_values": seen[:5]}
        )
    tuples = [tuple((v or "").strip() for v in r) for r in full]
    return {"row_count": len(full), "duplicate_row_count": len(tuples) - len(set(tuples)), "malformed": sum(len(r) > len(names) for r in rows), "columns": columns}


def check(spark, path):
    got, want = profile.profile_file(spark, path), oracle(path)
    assert got["columns"] == want["columns"]
    assert (got["row_count"], got["duplicate_row_count"]) == (want["row_count"], want["duplicate_row_count"])
    assert any(f"Detected {want['malformed']} malformed row(s) with extra fields." == w for w in got["warnings"]) == (want["malformed"] > 0)
    return got


def test_spatial_file(spark, tmp_path):
    path = write(tmp_path, SPATIAL)
    got = check(spark, path)
    assert (got["row_count"], got["column_count"], got["duplicate_row_count"], got["duplicate_row_pct"]) == (4, 6, 1, 25.0)
    assert got["temporal_candidates"] == ["event_datetime"]
    assert got["coordinate_profile"] == {"latitude_column": "latitude", "longitude_column": "longitude", "paired_non_null_count": 3, "valid_coordinate_count": 3, "valid_coordinate_pct": 100.0}
    by = {c["name"]: c for c in got["columns"]}
    assert by["event_id"]["inferred_type"] == "integer" and by["exposure"]["null_pct"] == 25.0
    assert (by["event_datetime"]["minimum"], by["event_datetime"]["maximum"]) == ("2025-01-01T08:00:00", "2025-01-02T09:30:00")
    assert len(got["warnings"]) == 1 and "duplicate" in got["warnings"][0]
    assert got["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and got["file_size_bytes"] == path.stat().st_size
    assert profile.profile_file(spark, path, now=datetime(2025, 1, 1, tzinfo=UTC))["generated_at_utc"] == "2025-01-01T00:00:00+00:00"
    json.dumps(got)


def test_semicolons(spark, tmp_path):
    got = check(spark, write(tmp_path, "district;events;category\nLima;20;A\nMiraflores;8;B\n"))
    assert got["delimiter"] == ";" and got["coordinate_profile"] is None and got["temporal_candidates"] == []
    assert any("latitude/longitude" in w for w in got["warnings"]) and any("temporal" in w for w in got["warnings"])


def test_odd_rows(spark, tmp_path):
    """Long, short, blank and white rows, quoted line breaks and delimiters, a byte-order mark."""
    body = '﻿a,b,c\n1,2,3,4\n1,2\n\n   \n"x\ny","q""q",3\n"l,m",,\n1,2,3,\n1,2,3,4,5\n5,"6",7\n'
    got = check(spark, write(tmp_path, body))
    assert [c["name"] for c in got["columns"]] == ["a", "b", "c"]
    assert "Detected 3 malformed row(s) with extra fields." in got["warnings"]


def test_headers_that_differ_by_case_only(spark, tmp_path):
    got = check(spark, write(tmp_path, "Lat,lat, LONGITUDE ,a.b,c`d\n1,2,3,4,5\n95,2,3,4,5\n"))
    assert got["coordinate_profile"]["latitude_column"] == "Lat" and got["coordinate_profile"]["longitude_column"] == " LONGITUDE "
    assert got["coordinate_profile"]["valid_coordinate_pct"] == 50.0
    assert "Less than 90% of non-null coordinate pairs are geographically valid." in got["warnings"]


def test_guards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        profile.profile_file(spark, tmp_path / "none.csv")
    with pytest.raises(ValueError, match="no header"):
        profile.profile_file(spark, write(tmp_path, ""))
    with pytest.raises(ValueError, match="duplicate header"):
        profile.profile_file(spark, write(tmp_path, "a,b,a\n1,2,3\n"))
    got = profile.profile_file(spark, write(tmp_path, "a,b\n"))
    assert got["row_count"] == 0 and got["duplicate_row_pct"] == 0.0 and got["columns"][0]["inferred_type"] == "empty"
    assert got["warnings"][0] == "Dataset contains no data rows."


@pytest.mark.parametrize(("good", "label"), [(90, "integer"), (89, "string")])
def test_threshold(spark, tmp_path, good, label):
    rows = ["v"] + [str(i) for i in range(good)] + ["x"] * (100 - good)
    assert check(spark, write(tmp_path, "\n".join(rows) + "\n"))["columns"][0]["inferred_type"] == label


def test_random_files(spark, tmp_path):
    rng = random.Random(8)
    pools = {
        "id": lambda i: str(i), "flag": lambda i: rng.choice(["yes", "NO", "sí", "si", "true"]), "mixed": lambda i: rng.choice(["yes", "1"]),
        "x": lambda i: rng.choice(["1.5", "-2", "1_000", "1e3", ".5", "5."]), "when": lambda i: rng.choice(["2025-01-01T08:00:00Z", "2025-03-01 07:00+05:00", "1/2/2025", "2025/3/4 1:2:3"]),
        "gap": lambda i: rng.choice(["", "NA", "null", " none ", "v"]), "word": lambda i: rng.choice(["a", "b ", " b", "ç", "12d"]),
    }
    rows = [",".join(pools)] + [",".join(f(i) for f in pools.values()) for i in range(300)]
    rows += rows[1:20]
    got = check(spark, write(tmp_path, "\n".join(rows) + "\n"))
    assert "Column 'gap' is at least 50% null." in got["warnings"]


@pytest.mark.parametrize(("values", "capped"), [("abc", False), ("abca", True), ("abcd", True), ("ab", False), ("aab", False), ("aabc", False), ("abcNA", False)])
def test_cap_depends_on_what_follows(spark, tmp_path, values, capped):
    items = ["a", "b", "c", "NA"] if values.endswith("NA") else list(values)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "o int, v string")
    row = profile.column_profiles(df, ["v"], "o", cap=3).first()
    assert row["unique_count_is_capped"] == capped and row["unique_count"] == min(3, len(set(items) - {"NA"}))


def test_exact_counts(spark, tmp_path):
    """Without a cap more distinct values than UNIQUE_CAP are counted, and nothing is said of a cap."""
    n = profile.UNIQUE_CAP + 5
    path = write(tmp_path, "id,x\n" + "".join(f"{i},{i % 3}\n" for i in range(n)))
    exact, capped = profile.profile_file(spark, path, cap=None), profile.profile_file(spark, path)
    assert [(c["unique_count"], c["unique_count_is_capped"]) for c in exact["columns"]] == [(n, False), (3, False)]
    assert [(c["unique_count"], c["unique_count_is_capped"]) for c in capped["columns"]] == [(profile.UNIQUE_CAP, True), (3, False)]
    assert [w for w in capped["warnings"] if w not in exact["warnings"]] == ["Column 'id' unique count reached the tracking cap (100000)."]


def test_cli(spark, tmp_path, capsys):
    path, out = write(tmp_path, SPATIAL), tmp_path / "r" / "report.json"
    assert cli.main(["profile", str(path), "--output", str(out)]) == 0
    assert json.loads(out.read_text())["row_count"] == 4 and out.read_text().endswith("}\n")
    capsys.readouterr()
    assert cli.main(["profile", str(path), "--delimiter", ","]) == 0
    assert json.loads(capsys.readouterr().out)["delimiter"] == ","
