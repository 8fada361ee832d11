"""Emberlake: event-risk analytics over sensor readings and point events, written for Spark."""
