"""Record linkage of reading lists and catalogue listings on Spark DataFrames."""

from shelflink.plans.link import closest_matches, link
from shelflink.plans.report import write_matches

__all__ = ["closest_matches", "link", "write_matches"]
