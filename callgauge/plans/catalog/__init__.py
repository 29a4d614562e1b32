"""All registered queries; importing the modules registers them."""

from callgauge.plans.catalog import alignment, features, models, summaries, tables, texts  # noqa: F401
