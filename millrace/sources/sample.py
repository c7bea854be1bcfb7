"""A small built-in table with every kind of defect: boats that called at a harbour."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.table import Table
from .files import rows_table

NAMES = ["Boat", "Arrived", "Skipper", "Berth fee", "Radio phone", "Dry dock", "Remarks"]
ROWS = [
    [" Kittiwake", "2021-05-02", "Vos, Hanne", "35.50", "+31 10 555 0100", "no", ""],
    ["kittiwake ", "2 May 2021", "Hanne Vos", "35.50", "0031 10 555 0100", "No", ""],
    ["Storm  Petrel", "17/06/2021", "Ruben Dias", "1,120.00", "(415) 555-0133", "yes", ""],
    ["Storm Petrel", "Jun 17, 2021", "Ruben Dias", "1,120.00", "415 555 0133", "YES", ""],
    ["Gannet", "2021/07/30", "", "48", "", "no", ""],
    ["Gannet", "2021/07/30", "", "48", "", "no", ""],
    ["Guillemot", "31.08.2021", "Aylin Kaya", "52.25", "n/a", "yes", ""],
    ["Guillemott", "31 Aug 2021", "Aylin Kaya", "52.25", "030 555 0142", "yes", ""],
    ["", "", "", "", "", "", ""],
    ["Razorbill", "12/25/2021", "Osei, Kwame", "60.75", "1-212-555-0177", "no", ""],
    ["RAZORBILL", "25 Dec 2021", "Kwame Osei", "60.75", "212 555 0177", "no", ""],
    ["Shearwater", "99/99/2021", "Mei Tan", "75", None, "yes", ""],
]


def sample_table(spark: SparkSession) -> Table:
    return rows_table(spark, NAMES, ROWS)
