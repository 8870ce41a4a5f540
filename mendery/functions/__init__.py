"""Column functions: text cleaning, dates, decimals and display labels."""
