"""Mail-campaign analytics as Spark plans: read, extract, cluster, compare, clean."""
