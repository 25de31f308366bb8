"""Spark operators over keyed prediction, feature and label tables."""
