"""tidewatch: sensor-anomaly analytics written for Apache Spark."""
