"""Recording names, vocabularies, label codes, time text and JSON repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: folder vocabulary of the recordings and its short codes
FOLDER_CODES = {
    "Accelerometer": "A12",
    "Dynamic Pressure Sensor": "P12",
    "Hydrophone": "H12",
    "Branched": "BR",
    "Looped": "LO",
    "Circumferential Crack": "CC",
    "Gasket Leak": "GL",
    "Longitudinal Crack": "LC",
    "No-leak": "NL",
    "Orifice Leak": "OL",
    "Background Noise": "N",
}

# fixed values: label codes, topologies, flow conditions, sensors
LABELS = {"NL": 0, "CC": 1, "GL": 2, "LC": 3, "OL": 4}
TOPOLOGIES = ["BR", "LO"]
FLOWS = ["0-18 LPS", "0-47 LPS", "ND", "Transient"]
CONTACT_SENSORS = ["A1", "A2", "P1", "P2"]
HYDROPHONES = ["H1", "H2"]
CONDITIONS = ["BC1", "BC2", "BC3", "BC4", "BC5", "BC6"]


def _code(value: Column, codes: dict, default: Column) -> Column:
    return reduce(lambda other, pair: F.when(value == pair[0], pair[1]).otherwise(other), codes.items(), default)


def folder_code(name: Column) -> Column:
    """Short code of a folder name; unknown names stay as they are."""
    return _code(name, FOLDER_CODES, name)


def file_code(name: Column) -> Column:
    """Recording file name in the short vocabulary.

    The first decimal point of a flow rate turns into ``-``; otherwise a background
    noise prefix turns into its code.
    """
    rate = F.regexp_replace(name, r"^([^.]*)\.", "$1-")
    noise = F.replace(name, F.lit("Background Noise"), F.lit("N"))
    return F.when(name.rlike(r"0\.\d+"), rate).otherwise(noise)


def label_code(label: Column) -> Column:
    return _code(label, LABELS, F.lit(None).cast("int"))


def topology_code(topology: Column) -> Column:
    return F.when(topology == "BR", 1).otherwise(0)


def recording_parts(file_name: Column) -> dict[str, Column]:
    """Attributes held in ``topology_label_flow[_noise]_sensor.csv`` or ``N_sensor.csv``."""
    stem = F.regexp_replace(F.regexp_extract(file_name, r"([^/]+)$", 1), r"\.csv$", "")
    parts = F.split(stem, "_")
    count = F.size(parts)
    is_noise = count == 2
    return {
        "is_noise": is_noise,
        "topology": F.when(~is_noise, F.get(parts, F.lit(0))),
        "label": F.when(~is_noise, F.get(parts, F.lit(1))),
        "flow": F.when(~is_noise, F.get(parts, F.lit(2))),
        "noise": F.when(is_noise, F.get(parts, F.lit(0))).when(count == 5, F.get(parts, F.lit(3))),
        "sensor": F.get(parts, count - 1),
    }


def condition_flags(condition: Column) -> dict[str, Column]:
    """One 0/1 column per background condition."""
    return {name: condition.contains(name).cast("int") for name in CONDITIONS}


def repair_quotes(text: Column) -> Column:
    """Single-quoted pseudo JSON to JSON."""
    return F.translate(text, "'", '"')


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds to ``yyyy-MM-dd HH:mm:ss`` in the session time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def text_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def round_tag(number: Column) -> Column:
    """Round number padded with zeros to at least three digits."""
    return F.format_string("%03d", number)
