"""The warehouse layers as SQL common table expressions, written apart from the Spark plans."""

# Raw lines with their defects; repeated lines come from a UNION ALL.
BRONZE = """
joined AS (
  SELECT l_orderkey AS ok, l_linenumber AS ln, l_quantity, l_extendedprice, l_discount, l_shipdate,
         o_orderdate, c_custkey AS ck, c_mktsegment, n_name, r_name, p_partkey, p_name, p_brand, p_type
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  JOIN part ON p_partkey = l_partkey
),
priced AS (
  SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                 AS DECIMAL(18,4)) AS amount,
         'Port City ' || (ck % 40) AS port
  FROM joined
),
raw_lines AS (
  SELECT ok, CAST(o_orderdate AS DATE) AS ordered, * EXCLUDE (ok) FROM priced
  UNION ALL
  SELECT ok, CAST(o_orderdate AS DATE) + 1 AS ordered, * EXCLUDE (ok) FROM priced WHERE ok % 4 = 1
),
bronze AS (
  SELECT
    'OR-' || ok AS Order_ID,
    strftime(ordered, '%Y-%m-%d') AS Order_Date,
    strftime(l_shipdate, '%Y-%m-%d') AS Ship_Date,
    'CU-' || ck AS Customer_ID,
    CASE WHEN (ok + ln) % 33 = 0 THEN NULL WHEN ck % 5 = 0 THEN 'Zoe ' || ck ELSE 'Ann ' || ck END
      AS Customer_Name,
    c_mktsegment AS Segment,
    'Synthetica' AS Country,
    CASE WHEN (ok * 7 + ln) % 32 = 0
         THEN CASE ln % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN ' none ' ELSE '' END
         ELSE CASE ln % 3 WHEN 0 THEN upper(port) WHEN 1 THEN lower(port) ELSE ' ' || port || ' ' END
    END AS City,
    CASE WHEN ok % 1000 = 7 THEN 'CA-2015-108119'
         ELSE CASE ln % 3 WHEN 0 THEN upper(n_name) WHEN 1 THEN lower(n_name) ELSE n_name END
    END AS State,
    CASE WHEN ck % 11 = 0 THEN NULL ELSE (10000 + ck % 80000) || '.0' END AS Postal_Code,
    r_name AS Region,
    'PR-' || p_partkey AS Product_ID,
    CASE WHEN p_type IN ('MEDIUM', 'LARGE')
           THEN CASE WHEN ok % 10 = 3 THEN 'Technlogy' ELSE 'Technology' END
         WHEN p_type IN ('STANDARD', 'SMALL')
           THEN CASE WHEN ok % 10 = 4 THEN 'Furnture' ELSE 'Furniture' END
         ELSE 'Office Supplies' END AS Category,
    p_brand AS Sub_Category,
    p_name || CASE WHEN ln = 7 THEN ' v2' ELSE '' END AS Product_Name,
    CAST(amount AS VARCHAR) AS Sales,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS Quantity,
    CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) AS Discount,
    CAST(CAST(amount * ((CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 4) * 15 - 10)
              * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(18,6)) AS VARCHAR) AS Profit
  FROM raw_lines
)"""

REPAIRED = """
cased AS (
  SELECT *,
    CASE WHEN upper(trim(City)) IN ('NONE', '') THEN 'Unknown' ELSE City END AS known_city,
    upper(trim(State)[1]) || lower(trim(State)[2:]) AS cased_state
  FROM bronze
),
repaired AS (
  SELECT Order_ID, CAST(Order_Date AS DATE) AS Order_Date, CAST(Ship_Date AS DATE) AS Ship_Date,
    Customer_ID, coalesce(Customer_Name, 'Unknown') AS Customer_Name, Segment, Country,
    upper(trim(known_city)[1]) || lower(trim(known_city)[2:]) AS City,
    CASE cased_state WHEN 'Ca-2015-108119' THEN 'Arkansas' ELSE cased_state END AS State,
    CAST(trunc(CAST(Postal_Code AS DOUBLE)) AS INTEGER) AS Postal_Code,
    Region, Product_ID,
    CASE Category WHEN 'Technlogy' THEN 'Technology' WHEN 'Furnture' THEN 'Furniture'
                  ELSE Category END AS Category,
    Sub_Category, Product_Name,
    CAST(Sales AS DECIMAL(18,4)) AS Sales, CAST(Quantity AS INTEGER) AS Quantity,
    CAST(Discount AS DECIMAL(18,4)) AS Discount, CAST(Profit AS DECIMAL(18,6)) AS Profit
  FROM cased
),
numbered AS (
  SELECT *, row_number() OVER (
      PARTITION BY Order_ID, Product_ID
      ORDER BY Order_Date NULLS FIRST, Ship_Date NULLS FIRST, Sales NULLS FIRST, Quantity NULLS FIRST,
               Discount NULLS FIRST, Profit NULLS FIRST, City NULLS FIRST, State NULLS FIRST,
               Customer_Name NULLS FIRST, Product_Name NULLS FIRST) AS rn
  FROM repaired
)"""

SILVER = """
silver AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM numbered WHERE rn = 1)"""

GOLD = """
dim_customer AS (
  SELECT DISTINCT ON (Customer_ID) Customer_ID, Customer_Name, Segment FROM silver
  ORDER BY Customer_ID, Customer_Name NULLS FIRST, Segment NULLS FIRST
),
members AS (
  SELECT DISTINCT ON (Product_ID) Product_ID, Product_Name, Category, Sub_Category FROM silver
  ORDER BY Product_ID, Product_Name NULLS FIRST, Category NULLS FIRST, Sub_Category NULLS FIRST
),
dim_product AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY Product_ID NULLS FIRST) AS Product_Key, * FROM members
),
places AS (SELECT City, State, Region, Country FROM silver GROUP BY ALL),
dim_geography AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY Country NULLS FIRST, State NULLS FIRST, City NULLS FIRST,
                                     Region NULLS FIRST) AS Geo_Key, *
  FROM places
),
dim_date AS (
  SELECT Order_Date, CAST(year(Order_Date) AS INTEGER) AS Year,
         CAST(month(Order_Date) AS INTEGER) AS Month
  FROM silver GROUP BY Order_Date
),
fact AS MATERIALIZED (
  SELECT s.Order_ID, s.Product_ID, s.Customer_ID, g.Geo_Key, p.Product_Key, s.Order_Date,
         s.Sales, s.Quantity, s.Profit, s.Discount
  FROM silver s
  LEFT JOIN dim_geography g ON g.Region = s.Region AND g.City = s.City AND g.State = s.State
                           AND g.Country IS NOT DISTINCT FROM s.Country
  LEFT JOIN dim_product p ON p.Product_ID = s.Product_ID
)"""

ON_BRONZE = f"WITH {BRONZE}"
ON_REPAIRED = f"{ON_BRONZE},{REPAIRED}"
ON_SILVER = f"{ON_REPAIRED},{SILVER}"
ON_GOLD = f"{ON_SILVER},{GOLD}"
