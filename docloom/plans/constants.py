"""Parameters shared by the registered queries and their SQL."""

AS_OF = "2025-01-01 00:00:00"
DIM = 64
SCORED = ["the", "esat", "que"]
TOP_WORDS = ["esat", "lich", "que"]
QUERY_VECTOR = [round(((i * 37) % DIM) / DIM - 0.5, 4) for i in range(DIM)]
