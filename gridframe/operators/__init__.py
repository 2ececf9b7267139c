"""Sheet operators (addressing, edits, cleaning, diff, profile, conform,
history, logs).  Each takes and returns DataFrames or Sheets."""
