"""rolesift: Spark jobs that land, judge, score, enrich and summarise job postings."""
