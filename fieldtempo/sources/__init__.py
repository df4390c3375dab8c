"""Campaign files in, tables out."""

from fieldtempo.sources.csv_files import (
    canonical,
    file_headers,
    read_campaigns,
    read_csv,
    read_source,
)
from fieldtempo.sources.landing import (
    Landed,
    land_by_campaign,
    land_campaigns,
    landed_bad_dates,
    landed_date_states,
    read_landed,
)
from fieldtempo.sources.listing import DataFile, file_states, list_files
from fieldtempo.sources.manifest import (
    CAMPAIGNS,
    DAY_FIRST_KM,
    ISO_METRES,
    MIXED_KM,
    MONTH_FIRST_METRES,
    Layout,
    Source,
    campaign_sources,
)

__all__ = [
    "CAMPAIGNS",
    "DAY_FIRST_KM",
    "DataFile",
    "ISO_METRES",
    "MIXED_KM",
    "MONTH_FIRST_METRES",
    "Landed",
    "Layout",
    "Source",
    "campaign_sources",
    "canonical",
    "file_headers",
    "file_states",
    "land_by_campaign",
    "land_campaigns",
    "landed_bad_dates",
    "landed_date_states",
    "list_files",
    "read_campaigns",
    "read_csv",
    "read_landed",
    "read_source",
]
