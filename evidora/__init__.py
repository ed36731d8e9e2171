"""Evidence-QA analytics as DataFrame programs: score, aggregate, compare, diagnose, audit and export recorded runs."""
