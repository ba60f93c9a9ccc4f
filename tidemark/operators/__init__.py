"""Batch operators over keyed, time-ordered tables."""
