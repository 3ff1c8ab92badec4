"""Records of what was checked: validation evidence, inspections, definitions, and the export of a run."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import space
from ..operators.detection import Gates
from ..operators.gates import passing_summary
from ..operators.pairing import GateError
from ..operators.regimes import RADIUS_KM
from .profile import axis_profile, field_statistics, text_evidence, time_profile, value_profile
from .sinks import BundleError, markdown, write_bundle


def plain(value: object) -> object:
    """What JSON can say: no NaN, no numpy or date types, text keys."""
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    return plain(value.item()) if hasattr(value, "item") else str(value)


def _rows(df: DataFrame) -> list[dict]:
    """For tables of one row a field or an axis."""
    return [plain(r.asDict(recursive=True)) for r in df.collect()]


def validation_record(atmosphere: DataFrame, static: DataFrame, fields: Sequence[str], static_fields: Sequence[str], provenance: Mapping[str, object]) -> dict:
    """Statistics of the fields of a day and of the ground below, if both lie on one grid; else GateError.

    Both tables have (lat, lon, fields). Coordinates are the same if they agree to a millionth of a degree.
    """
    at = [F.round(F.col(c).cast("double"), 6).alias(c) for c in ("lat", "lon")]
    a, b = atmosphere.select(*at).distinct().withColumn("_a", F.lit(1)), static.select(*at).distinct().withColumn("_b", F.lit(1))
    apart = a.join(b, ["lat", "lon"], "full").where("_a IS NULL OR _b IS NULL").limit(1).collect()
    if apart:
        raise GateError(f"the two grids differ at {apart[0].lat}, {apart[0].lon}")
    return {
        "status": "PASS",
        "grid": _rows(axis_profile(static, "lat").unionByName(axis_profile(static, "lon"))),
        "atmosphere": _rows(field_statistics(atmosphere, fields)),
        "static": _rows(field_statistics(static, static_fields)),
        "provenance": plain(provenance),
    }


def inspection_record(name: str, df: DataFrame, value: str, attributes: DataFrame, time: str = "time", lat: str = "lat", lon: str = "lon") -> dict:
    """What an unknown observation table holds. It never sets a convention; wording found is for a human to judge."""
    hits = _rows(text_evidence(attributes).orderBy("place", "name"))
    verdict = "text found, to be read by a human" if hits else "no evidence in the file"
    return {
        "name": name,
        "axes": _rows(axis_profile(df, lat).unionByName(axis_profile(df, lon))),
        "time": _rows(time_profile(df, time, [lat, lon]))[0],
        "values": _rows(value_profile(df, value))[0],
        "evidence": hits,
        "convention": "UNVERIFIED",
        "verdict": verdict,
    }


def record_markdown(title: str, record: Mapping[str, object]) -> str:
    """A record as Markdown: facts as a list, lists of rows as tables."""
    lines = [f"# {title}", ""]
    for key, part in record.items():
        if isinstance(part, list) and part and all(isinstance(r, Mapping) for r in part):
            names = list(part[0])
            lines += ["", f"## {key}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
            lines += ["| " + " | ".join("" if r.get(n) is None else str(r[n]).replace("|", "\\|").replace("\n", " ") for n in names) + " |" for r in part]
        elif isinstance(part, Mapping):
            lines += ["", f"## {key}", "", *(f"- {k}: {v}" for k, v in part.items())]
        else:
            lines.append(f"- {key}: {part if part != [] else 'none'}")
    return "\n".join(lines) + "\n"


def write_record(spark: SparkSession, path: str, title: str, record: Mapping[str, object]) -> None:
    """The record as one JSON and one Markdown file, in folders that Spark writes; never over others."""
    told = [("json", json.dumps(plain(record), sort_keys=True, allow_nan=False)), ("markdown", record_markdown(title, record))]
    for form, text in told:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/{form}")


def definitions(gates: Gates = Gates(box=space.SYSTEM_BOX)) -> dict:
    """Which rules the regimes follow, with their thresholds; those of systems are read from the gates that detection uses.

    Nothing here is an official declaration of any event: all classes are objective stand-ins or scores.
    """
    low = f"a local minimum of pressure whose departure from a Gaussian background of {gates.sigma_cells:g} cells is at most -{gates.residual:g} hPa, vorticity at least {gates.vorticity:g}e-5 a second, and a complete ring at {gates.ring_degrees:g} degrees at least {gates.depth:g} hPa higher"
    return {
        "regions": [{"region": str(n)} for n in space.REGIONS],
        "systems": [{"class": name, "radius_km": RADIUS_KM[code]} for code, name in ((1, "low"), (2, "depression"))],
        "monsoon state": {"active": "anomaly of at least one deviation", "break": "anomaly of at most minus one deviation", "months": "July and August"},
        "thresholds": [
            {"axis": "active and break", "rule": "area-weighted land rain of the zone; anomaly by the day of the year, smoothed over 31 days, of at least one deviation for 3 consecutive days of July and August; 20 years needed", "kind": "objective stand-in"},
            {"axis": "low", "rule": low, "kind": "objective stand-in"},
            {"axis": "depression", "rule": "a low with a ring at least 4 hPa higher, vorticity of at least 2e-5 a second and wind of at least 8.7 m/s around it", "kind": "objective stand-in"},
            {"axis": "separation", "rule": f"centres at least {gates.separation_degrees:g} degrees apart, the deepest first, {gates.most} a time at most", "kind": "objective stand-in"},
            {"axis": "western disturbance", "rule": "not detected: no upstream track and no climatology of vorticity aloft", "kind": "not supported"},
            {"axis": "orographic", "rule": "upslope flow, score 1 at 0.12 m/s", "kind": "heuristic score"},
            {"axis": "coastal", "rule": "onshore wind, score 1 at 8 m/s, falling off over 150 km from the sea", "kind": "heuristic score"},
            {"axis": "convective", "rule": "CAPE over 2500 J/kg times water over 60 kg/m2, each 1 at most", "kind": "heuristic score"},
        ],
    }


def capability_record(status: str, move_to_learning: bool, capabilities: Mapping[str, Mapping[str, object]], data: Mapping[str, object], decision: str) -> dict:
    """What a run could tell, as a record of several sections for `write_record`: each capability with its availability, what was detected, its kind and why."""
    rows = [{"capability": name, "available": bool(c["available"]), "detected": c.get("detected"), "kind": c["kind"], "reason": c["reason"]} for name, c in capabilities.items()]
    return {"status": status, "move to regime-aware learning": "YES" if move_to_learning else "NO", "capabilities": rows, "data": dict(data), "decision": decision}


def verification_report(title: str, sections: Mapping[str, DataFrame], notes: Mapping[str, str] | None = None) -> str:
    """Small tables of scores as one Markdown report, a section each, with a note under its heading where there is one."""
    lines = [f"# {title}"]
    for name, table in sections.items():
        lines += ["", f"## {name}", ""]
        if notes and name in notes:
            lines += [notes[name], ""]
        lines.append(markdown(table))
    return "\n".join(lines) + "\n"


def export_run(path: str, payloads: Mapping[str, object], summaries: Mapping[str, Mapping[str, object]], trained: Mapping[str, object] | None = None) -> dict:
    """A checksummed bundle of a run: of its validated evidence where there is any, else of the trained run.

    Evidence that is there and did not pass is an error, and never gives way to the trained run.
    """
    if summaries:
        name, summary = passing_summary(summaries)
        about = {"phase": "validated", "evidence": name, "summary": summary}
    elif trained is not None:
        about = {"phase": "trained", "summary": trained, "warning": "scores of a trained run without validated evidence"}
    else:
        raise BundleError("neither validated evidence nor a trained run")
    return write_bundle(path, {**{k: plain(v) for k, v in payloads.items()}, "about": plain(about)})
