"""Fixed parameters of the registered queries (the ``as_of`` clock, report
periods and search criteria), shared by the Spark side and the SQL side."""

AS_OF = "1999-01-01 00:00:00"          # "now" of cars_report
FIN_START = "1997-01-01 00:00:00"      # fin_report period, both ends inclusive
FIN_END = "1997-03-31 00:00:00"
EXPIRE_AT = "1998-01-01 00:00:00"      # expired_orders: returned_at <= this
TICK_AT = "1995-01-25 00:00:00"        # fleet_tick clock
FIND_TYPE = "PROMO"                    # find_car_by_type / find_car_any_state
FIND_COLOR = "red"                     # find_car_any_state
PICK_SEED = "fleet"                    # pick_free_car seed
V_USER = "BATCH"                       # user recorded by batch commands
EXPIRE_ID_OFFSET = 10 ** 15          # history ids of expired_orders: offset + order id
ORDER_ID_OFFSET = 10 ** 12             # add_orders: new order id = offset + seq
STREAM_FILE_ROWS = 20000               # order_change_stream: events of a file at most
STREAM_BLOCK_ORDERS = 8000             # order_change_stream: orders of a state block
STREAM_LATE = "800 days"               # over two years: a micro-batch may hold files of two
LOOKUP_KEYS = list(range(1, 1000, 27))   # client_lookup, car_lookup: numbers of the keys
ROLLING_CUTS = [1994, 1996]            # rolling reports: a batch ends before each of these years
DIFF_ID_OFFSET = 2 * 10 ** 15          # orders_diff_log: history id = offset + order id
PART_CARS = 10                         # client_report_parts: cars of a piece
