"""Evidence admission, claim grounding and lineage as Spark plans."""
