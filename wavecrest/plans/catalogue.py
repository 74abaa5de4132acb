"""All queries over signals and their SQL."""

from wavecrest.plans import arithmetic, chains, chances, choices, clips, containers, files, hearing, integers, levels, listings, packets, rules, search, sequence, spectrum, stereo, streams, transforms

MODULES = (levels, stereo, spectrum, sequence, search, arithmetic, rules, containers, packets, chains, chances, transforms, integers, hearing, choices, clips, listings, files, streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
