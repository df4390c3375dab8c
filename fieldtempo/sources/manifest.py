"""What each campaign's files look like."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldtempo.functions import parse_dmy_hms, parse_iso, parse_mdy_hm, parse_mixed


@dataclass(frozen=True)
class Layout:
    """Column names (after header normalisation), date reading and accuracy threshold."""

    delivered: str
    enumerator: str
    distance: str
    threshold: float  # in the unit of the distance column; a delivery on it is accurate
    parse: Callable[[DataFrame, str, str], DataFrame]  # table, text column, column to add
    property_type: str | None = None  # comma list, each entry a delivery of its own
    drop_missing_dates: bool = False

    @property
    def required(self) -> list[str]:
        names = [self.delivered, self.enumerator, self.distance]
        return names + ([self.property_type] if self.property_type else [])


@dataclass(frozen=True)
class Source:
    """One campaign: its labels, its layout, and its files.

    A path may be a file, a folder or a glob. Files may differ in their headers; they are stacked by
    column name.
    """

    city: str
    year: int
    layout: Layout
    paths: tuple[str, ...]
    multiline: bool = False  # quoted values hold line breaks; such files cannot be split


# Column names, thresholds (80 m) and date formats of the known layouts.
ISO_METRES = Layout("delivered_on", "mobile_user_username", "distance", 80.0, parse_iso)
MONTH_FIRST_METRES = Layout("delivered_on", "user_name", "distance", 80.0, parse_mdy_hm)
DAY_FIRST_KM = Layout(
    "time_delivery_date",
    "enteredby",
    "time_gps_distance_original",
    0.08,
    parse_dmy_hms,
    property_type="property_type",
    drop_missing_dates=True,
)
MIXED_KM = Layout(
    "time_delivery_date",
    "enteredby",
    "time_gps_distance_original",
    0.08,
    parse_mixed,
    property_type="property_type",
    drop_missing_dates=True,
)

# The known campaigns and the data files each is read from.
CAMPAIGNS = (
    ("Makeni", 2025, ISO_METRES, ("mcc_2025.csv",)),
    ("Kenema", 2025, MONTH_FIRST_METRES, ("kcc_2025.csv",)),
    ("Kenema", 2024, DAY_FIRST_KM, ("kcc_2024.csv",)),
    ("Freetown", 2025, DAY_FIRST_KM, ("fcc_2025_rnd1_team_1-3.csv", "fcc_2025_rnd1_team_4-6.csv")),
    ("Freetown", 2024, MIXED_KM, ("fcc_2024_team_1-3.csv", "fcc_2024_team_4-6.csv")),
    ("Freetown", 2023, MIXED_KM, ("fcc_2023_team_1-3.csv", "fcc_2023_team_4-6.csv")),
    ("Freetown", 2022, MIXED_KM, ("fcc_2022_team_1-3.csv", "fcc_2022_team_4-6.csv")),
    ("Freetown", 2021, MIXED_KM, ("fcc_2021_team_1-3.csv", "fcc_2021_team_4-6.csv")),
)


def campaign_sources(folder: str) -> list[Source]:
    """The known campaigns, with their files under ``folder``."""
    return [
        Source(city, year, layout, tuple(f"{folder.rstrip('/')}/{name}" for name in names))
        for city, year, layout, names in CAMPAIGNS
    ]
