"""folio: a Spark-native engine for turning crawled web pages into an
ordered, documented Markdown corpus.

Pages are parsed once into a ``nodes`` table (one row per element, text
node or comment, numbered in document order with the subtree interval
``[node_id, end_id]``); every rule after that is a DataFrame expression,
join, window or aggregate that Catalyst can plan.
"""

from folio.profile import SiteProfile, DEFAULT_PROFILE

__all__ = ["SiteProfile", "DEFAULT_PROFILE"]
