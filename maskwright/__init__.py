"""maskwright: personal-data detection and pseudonymisation as Spark DataFrame plans."""
