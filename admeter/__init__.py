"""Ad-event analytics as Spark jobs: validate, de-duplicate, attribute, count, serve, reconcile."""
