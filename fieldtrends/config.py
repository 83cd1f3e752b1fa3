"""Parameters of the analysis: periods, thresholds, status orders and other fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values: statuses
TREND_STATUSES = [
    "Rapid Decline", "Decline", "Insufficient Data", "Trend Inconclusive",
    "Stable", "Increase", "Rapid Increase",
]
TREND_STATUS_REPORT_ORDER = [
    "Rapid Decline", "Decline", "Stable", "Increase", "Rapid Increase",
    "Trend Inconclusive", "Insufficient Data",
]
RANGE_STATUSES = ["Historical", "Very Restricted", "Restricted", "Moderate", "Large", "Very Large"]
PRIORITY_STATUSES = ["High", "Moderate", "Low"]
DECLINE = ["Decline", "Rapid Decline"]
UNCERTAIN = ["Insufficient Data", "Trend Inconclusive"]
RESTRICTED = ["Historical", "Very Restricted", "Restricted"]
PAST_TREND_STATUSES = [
    "Strong Decline", "Moderate Decline", "Data Deficient", "Uncertain",
    "Stable", "Moderate Increase", "Strong Increase",
]
PAST_DECLINE = ["Moderate Decline", "Strong Decline"]
PAST_UNCERTAIN = ["Data Deficient", "Uncertain"]
IUCN_ORDER = [
    "Critically Endangered", "Endangered", "Vulnerable", "Near Threatened",
    "Least Concern", "Not Recognised",
]

# ---------------------------------------------------------------- fixed values: calendar
CUMULATIVE_DAYS = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
SEASONS = {"Win": [12, 1, 2], "Sum": [3, 4, 5], "Mon": [6, 7, 8], "Aut": [9, 10, 11]}
SEASON_NAMES = ["Aut", "Mon", "Sum", "Win"]

# ---------------------------------------------------------------- fixed values: migratory status
RESIDENT_STATUSES = [
    "Resident", "Resident & Altitudinal Migrant", "Resident & Local Migrant",
    "Resident & Localized Summer Migrant", "Altitudinal Migrant", "Resident (Extirpated)",
]
SEASON_CODES_R = [
    "Resident", "Resident & Altitudinal Migrant", "Altitudinal Migrant",
    "Resident (Extirpated)", "Uncertain",
]
SEASON_CODES_SUMMER_WINTER = [
    "Local Migrant", "Local Migrant & Summer Migrant", "Local Migrant & Winter Migrant",
    "Localized Summer Migrant & Localized Winter Migrant", "Resident & Local Migrant",
    "Resident & Localized Summer Migrant", "Resident & Summer Migrant",
    "Resident & Winter Migrant", "Resident & Within-India Migrant",
    "Summer Migrant & Localized Winter Migrant", "Summer Migrant & Winter Migrant",
    "Winter Migrant & Localized Summer Migrant", "Within-India Migrant",
    "Within-India Migrant & Winter Migrant",
]
SEASON_CODES_PASSAGE_SUMMER = [
    "Passage Migrant & Localized Summer Migrant", "Summer Migrant & Passage Migrant",
]
SEASON_CODES_PASSAGE_WINTER = ["Passage Migrant & Localized Winter Migrant"]
CODE_MONTHS = {"MP": [9, 10, 11, 3, 4, 5], "MS": [5, 6, 7, 8], "MW": [11, 12, 1, 2]}

# ---------------------------------------------------------------- fixed values: classification
LONG_TERM_WIDTH = 0.5
LONG_TERM_BOUNDS = (50.0, 75.0, 100.0, 125.0, 150.0)
CURRENT_WIDTH = 6.0
CURRENT_BOUNDS = (-2.7, -1.1, 0.0, 0.9, 1.6)
RANGE_BOUNDS = (625.0, 7500.0, 42500.0, 250000.0, 1000000.0)
Z95 = 1.96

# status -> (band minimum, band maximum, limit used, width of the new band, offset)
LONG_TERM_BANDS = [
    ("Rapid Decline", 0.0, 50.0, "rci", 2.0, -5.0),
    ("Decline", 50.0, 75.0, "rci", 2.0, -3.0),
    ("Stable-", 75.0, 100.0, "mean", 1.0, -1.0),
    ("Stable+", 100.0, 125.0, "mean", 1.0, 0.0),
    ("Increase", 125.0, 150.0, "lci", 2.0, 1.0),
    ("Rapid Increase", 150.0, 200.0, "lci", 2.0, 3.0),
]
CURRENT_BANDS = [
    ("Rapid Decline", -4.7, -2.7, "rci", 2.0, -5.0),
    ("Decline", -2.7, -1.1, "rci", 2.0, -3.0),
    ("Stable-", -1.1, 0.0, "mean", 1.0, -1.0),
    ("Stable+", 0.0, 0.9, "mean", 1.0, 0.0),
    ("Increase", 0.9, 1.6, "lci", 2.0, 1.0),
    ("Rapid Increase", 1.6, 3.6, "lci", 2.0, 3.0),
]

# ---------------------------------------------------------------- fixed values: reports
BREAKUP_ORDER = ["Trend New", "Trend Different", "Range", "IUCN"]
UPLIST_ORDER = [
    "More decline in LTT", "More decline in CAT", "First-time trend", "First-time LTT",
    "First-time CAT", "Other changes in trends", "Loss of trends", "Reducing range", "Others",
]
DOWNLIST_ORDER = [
    "Less decline in LTT", "Less decline in CAT", "First-time trend", "First-time LTT",
    "First-time CAT", "Other changes in trends", "Loss of trends", "Increasing range", "Others",
]
HABITAT_GROUPS = {
    "Forest": "Woodland", "Forest & Plantation": "Woodland",
    "Grassland": "Open Landscape", "Grassland & Scrub": "Open Landscape",
    "Alpine & Cold Desert": "Open Landscape", "Open Habitat": "Open Landscape",
}
REDLIST_STEPS = [
    (80.0, "Critically Endangered"), (50.0, "Endangered"), (30.0, "Vulnerable"),
    (20.0, "Near Threatened"), (0.0, "Least Concern"),
]

# ---------------------------------------------------------------- fixed values: taxonomic lumping
# (recorded name, name to keep, whether the record becomes category "species")
LUMPED_TAXA = [
    ("Green Warbler", "Greenish Warbler", False),
    ("Green/Greenish Warbler", "Greenish Warbler", True),
    ("Amur Stonechat", "Siberian Stonechat", False),
    ("Siberian/Amur Stonechat", "Siberian Stonechat", True),
    ("Red-necked Stint", "Little Stint", False),
    ("Red-necked/Little Stint", "Little Stint", True),
    ("Eastern Yellow Wagtail", "Western Yellow Wagtail", False),
    ("Western/Eastern Yellow Wagtail", "Western Yellow Wagtail", True),
    ("Himalayan Buzzard", "Common Buzzard", False),
    ("Common/Himalayan Buzzard", "Common Buzzard", True),
    ("Eastern Marsh Harrier", "Western Marsh Harrier", False),
    ("Western/Eastern Marsh Harrier", "Western Marsh Harrier", True),
    ("Greater Sand-Plover", "Tibetan Sand-Plover", False),
    ("Tibetan/Greater Sand-Plover", "Tibetan Sand-Plover", True),
    ("Baikal Bush Warbler", "Spotted Bush Warbler", False),
    ("Baikal/Spotted Bush Warbler", "Spotted Bush Warbler", True),
    ("Sichuan Leaf Warbler", "Lemon-rumped Warbler", False),
    ("Lemon-rumped/Sichuan Leaf Warbler", "Lemon-rumped Warbler", True),
    ("Pale Martin", "Gray-throated Martin", False),
    ("Bank Swallow/Pale Martin", "Gray-throated Martin", True),
    ("Riparia sp.", "Gray-throated Martin", True),
    ("Mongolian Short-toed Lark", "Greater Short-toed Lark", False),
    ("Greater/Mongolian Short-toed Lark", "Greater Short-toed Lark", True),
    ("Taiga Flycatcher", "Red-breasted Flycatcher", False),
    ("Taiga/Red-breasted Flycatcher", "Red-breasted Flycatcher", True),
    ("Chestnut Munia", "Tricolored Munia", False),
    ("Tricolored x Chestnut Munia (hybrid)", "Tricolored Munia", True),
    ("House Swift", "Little Swift", False),
    ("Little/House Swift", "Little Swift", True),
    ("Swinhoe's Snipe", "Pin-tailed Snipe", False),
    ("Pin-tailed/Swinhoe's Snipe", "Pin-tailed Snipe", True),
    ("Sykes's Warbler", "Booted Warbler", False),
    ("Booted/Sykes's Warbler", "Booted Warbler", True),
    ("Iduna sp.", "Booted Warbler", True),
    ("Malabar Flameback", "Greater Flameback", False),
    ("Greater/Malabar Flameback", "Greater Flameback", True),
    ("Nicobar Hooded Pitta", "Western Hooded Pitta", False),
    ("Oriental Cuckooshrike", "Indian Cuckooshrike", False),
    ("Indian/Oriental Cuckooshrike", "Indian Cuckooshrike", True),
    ("European Red-rumped Swallow", "Eastern Red-rumped Swallow", False),
    ("European/Eastern Red-rumped Swallow", "Eastern Red-rumped Swallow", True),
    ("Hainan Blue Flycatcher", "Blue-throated Flycatcher", False),
    ("Hainan Blue/Blue-throated/Chinese Blue Flycatcher", "Blue-throated Flycatcher", True),
]
BANNED_SPECIES = ["Orange Ground-Thrush", "Bar-bellied Cuckooshrike"]


@dataclass(frozen=True)
class Completeness:
    """Limits of the completeness check on self-declared complete checklists."""

    max_km: float = 10.0
    max_speed_kmh: float = 20.0
    min_minutes: float = 3.0
    min_species_per_hour: float = 2.0
    small_list: int = 3
    night_ends: int = 4
    night_starts: int = 20


@dataclass(frozen=True)
class Qualification:
    """Data needed before a species is analysed; states use the lower set."""

    localities: int = 15
    cells: int = 4
    lists: int = 50

    @staticmethod
    def for_mask_type(mask_type: str) -> "Qualification":
        return Qualification(10, 4, 30) if mask_type == "state" else Qualification()


@dataclass(frozen=True)
class YearInfo:
    """Periods of the analysis: historical bins (label, last year, median), then single years."""

    latest_year: int
    bins: tuple[tuple[str, int, int], ...]
    full_years: tuple[int, ...]
    recent_from: int = 2015
    recent_max: int = 10
    projection: int = 7
    extra: dict = field(default_factory=dict)

    @property
    def last_bin_year(self) -> int:
        return self.bins[-1][1]

    @property
    def single_years(self) -> list[int]:
        return [y for y in sorted(self.full_years) if y > self.last_bin_year]

    @property
    def labels(self) -> list[str]:
        return [b[0] for b in self.bins] + [str(y) for y in self.single_years]

    @property
    def medians(self) -> list[int]:
        return [b[2] for b in self.bins] + self.single_years

    @property
    def recent_years(self) -> list[int]:
        kept = [y for y in sorted(self.full_years) if y >= self.recent_from]
        return kept[-self.recent_max:]

    @property
    def recent_start(self) -> int:
        return min(self.recent_years)

    @property
    def projection_years(self) -> list[int]:
        return [self.latest_year + i for i in range(1, self.projection + 1)]

    @property
    def projection_columns(self) -> list[str]:
        return [f"proj{y}.{s}" for y in self.projection_years for s in ("lci", "mean", "rci")]


def country_bins(medians: tuple[int, int, int, int] = (1992, 2003, 2009, 2012)):
    """Historical bins of the country analysis; the last label is a single year."""
    m = medians
    return (
        ("before 2000", 1999, m[0]), ("2000-2006", 2006, m[1]),
        ("2007-2010", 2010, m[2]), ("2011-2012", 2012, m[3]), ("2013", 2013, 2013),
    )
