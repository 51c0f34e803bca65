"""Named queries by area; importing this package registers all of them."""

from cladeworks.plans.roster import compare, consequence, features, intervals, phenotype, quality, reads, results, tree  # noqa: F401
